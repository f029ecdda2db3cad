"""Monthly insight tables, for all ledgers and months at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.thresholds import NON_SPEND, STOPPED_AFTER_DAYS


def _with_month(rows: DataFrame) -> DataFrame:
    return rows.withColumn("month", S.month_of(F.col("txn_date")))


def monthly_verdict(rows: DataFrame) -> DataFrame:
    """What came in, went out, was invested and kept; ``rows`` are transactions with labels.

    One pass of conditional sums, combined before the shuffle. In = Out + Invested +
    Kept holds by construction.
    """
    category, sub = F.coalesce("category", F.lit("")), F.coalesce("subcategory", F.lit(""))
    credit, debit = F.col("debit_credit") == "credit", F.col("debit_credit") == "debit"
    total = lambda where: F.coalesce(F.sum(F.when(where, F.col("amount"))), F.lit(0).cast("decimal(28,2)"))
    sums = _with_month(rows).groupBy("ledger_id", "month").agg(
        total(credit & (category != "Self Transfers") & ~((category == "Income") & (sub == "Opening Balance"))).alias("i"),
        total(credit & (category == "Income") & ~sub.isin("Refund", "Opening Balance")).alias("e"),
        total(debit & ~category.isin("Self Transfers", "Investments")).alias("o"),
        total(debit & (category == "Investments")).alias("v"),
    )
    kept = F.col("i") - F.col("o") - F.col("v")
    return sums.select(
        "ledger_id",
        "month",
        S.money(F.col("i")).alias("money_in"),
        S.money(F.col("e")).alias("earned"),
        S.money(F.col("o")).alias("money_out"),
        S.money(F.col("v")).alias("invested"),
        S.money(kept).alias("kept"),
        F.when(F.col("i") > 0, F.round((kept.cast("double") / F.col("i").cast("double")).cast("decimal(28,8)"), 4).cast("double")).alias("kept_rate"),
        S.money(F.col("i") - F.col("e")).alias("other_in"),
    )


def category_net_spend(rows: DataFrame, offsets: DataFrame) -> DataFrame:
    """Gross, count, offsets and net per ledger, month and category, with rows of offsets alone.

    ``offsets`` has ledger_id, month, category, amount.
    """
    spend = _with_month(rows).where((F.col("debit_credit") == "debit") & S.is_spend(F.col("category")))
    gross = spend.groupBy("ledger_id", "month", S.spend_category(F.col("category")).alias("category")).agg(F.sum("amount").alias("g"), F.count("*").alias("count"))
    back = offsets.groupBy("ledger_id", "month", "category").agg(F.sum("amount").alias("b"))
    zero = F.lit(0).cast("decimal(28,2)")
    both = gross.join(back, ["ledger_id", "month", "category"], "full").withColumn("g", F.coalesce("g", zero)).withColumn("b", F.coalesce(F.round("b", 2), zero))
    return both.select(
        "ledger_id", "month", "category", S.money(F.col("g")).alias("gross"), F.coalesce("count", F.lit(0)).alias("count"), S.money(F.col("b")).alias("offsets"), S.money(F.col("g") - F.col("b")).alias("net")
    )


def subcategory_breakdown(rows: DataFrame) -> DataFrame:
    """Spend per canonical subcategory, with the category's total as the row of a null subcategory."""
    spend = _with_month(rows).where((F.col("debit_credit") == "debit") & S.is_spend(F.col("category")))
    named = spend.select("ledger_id", "month", S.spend_category(F.col("category")).alias("category"), S.canonical_subcategory(F.col("subcategory")).alias("subcategory"), "amount")
    sets = named.groupingSets([["ledger_id", "month", "category", "subcategory"], ["ledger_id", "month", "category"]], "ledger_id", "month", "category", "subcategory")
    return sets.agg(S.money(F.sum("amount")).alias("total"), F.count("*").alias("count"))


def month_over_month(net: DataFrame) -> DataFrame:
    """Net spend beside that of the calendar month before, either of which may lack."""
    before = net.select("ledger_id", S.next_month(F.col("month")).alias("month"), "category", F.col("net").alias("prev_net"))
    both = net.select("ledger_id", "month", "category", "net").join(before, ["ledger_id", "month", "category"], "full")
    seen = net.select("ledger_id", "month").distinct()  # months after the last are no months
    both = both.join(seen, ["ledger_id", "month"], "left_semi")
    both = both.withColumn("net", F.coalesce("net", F.lit(0.0))).withColumn("prev_net", F.coalesce("prev_net", F.lit(0.0)))
    return both.withColumn("delta", F.round(F.col("net") - F.col("prev_net"), 2))


def what_changed(deltas: DataFrame, top: int = 3) -> DataFrame:
    """The largest changes of 1 or more in each ledger and month."""
    place = Window.partitionBy("ledger_id", "month").orderBy(F.abs("delta").desc(), "category")
    return deltas.where(F.abs("delta") >= 1).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)


def _mode(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value that is not null, ties to the first by name."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(f"{value}_mode"))


def recurring_charges(rows: DataFrame) -> DataFrame:
    """Charges of one amount to one counterparty that come back across months."""
    keys = ["ledger_id", "key", "amount"]
    latest = rows.groupBy("ledger_id").agg(F.max("txn_date").alias("latest"))
    charges = rows.where((F.col("debit_credit") == "debit") & F.col("counterparty_key").isNotNull() & ~F.coalesce("category", F.lit("")).isin("Transfers", "Self Transfers"))
    charges = charges.select("ledger_id", F.col("counterparty_key").alias("key"), F.round("amount").cast("bigint").alias("amount"), "txn_date", "row_seq", "category", "merchant")
    before = Window.partitionBy(*keys).orderBy("txn_date", "row_seq")
    gaps = charges.withColumn("month", S.month_of(F.col("txn_date"))).withColumn("gap", F.datediff("txn_date", F.lag("txn_date").over(before)))
    units = gaps.groupBy(*keys).agg(
        F.countDistinct("month").alias("months_seen"), F.min("month").alias("lo"), F.max("month").alias("hi"), F.count("*").alias("n"), F.median("gap").alias("gap"),
        F.max_by("category", F.struct("txn_date", "row_seq")).alias("category"), F.max("txn_date").alias("last_date"),
    )
    span = S.month_index(F.col("hi")) - S.month_index(F.col("lo")) + 1
    commitment = F.coalesce(F.col("category").isin("Subscriptions", "Investments"), F.lit(False))
    months = F.col("months_seen")
    units = units.withColumn("months_span", span).where((F.col("n") <= 1.5 * months) & (((months >= 3) & (months >= 0.6 * span)) | ((months >= 2) & commitment)))
    named = units.join(_mode(charges, keys, "merchant"), keys, "left").join(latest, "ledger_id")
    return named.select(
        "ledger_id", "key", F.coalesce("merchant_mode", F.initcap("key")).alias("name"), "category", "amount", "months_seen", "months_span",
        F.when(F.col("gap").between(25, 35), "monthly").otherwise("irregular").alias("cadence"), "last_date", (F.datediff("latest", "last_date") <= STOPPED_AFTER_DAYS).alias("active"),
    )


def committed_by_name(recurring: DataFrame) -> DataFrame:
    """Recurring money per ledger and name: all, of active items, and of monthly active ones."""
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("amount"))), F.lit(0))
    return recurring.groupBy("ledger_id", "name").agg(
        F.count("*").alias("items"), total(F.col("active")).alias("active_total"), total(F.col("active") & (F.col("cadence") == "monthly")).alias("monthly_total"), total(~F.col("active")).alias("stopped_total")
    )


def people_ledger(rows: DataFrame, people: DataFrame, settled: DataFrame) -> DataFrame:
    """What each person sent and got; rows that match nobody have a null person.

    Transfers that are no cash and no settled credit, matched by exact merchant first,
    then by a name or token of four characters or more in the counterparty or merchant.
    Distinct (counterparty, merchant) meet people through their runs of four characters:
    a token is joined by its first four to the texts that have these, and tested there, so
    no row meets all people of its ledger.
    """
    key, merchant = F.lower(F.coalesce("counterparty_key", F.lit(""))), F.lower(F.coalesce("merchant", F.lit("")))
    moved = rows.where((F.col("category") == "Transfers") & (F.coalesce("subcategory", F.lit("")) != "ATM Withdrawal"))
    moved = moved.join(settled.select("id").distinct(), "id", "left_anti").select("ledger_id", "id", "amount", "debit_credit", "txn_date", key.alias("cpk"), merchant.alias("m"))
    who = people.select("ledger_id", F.col("id").alias("person_id"), "name", "relationship", F.lower("name").alias("n"), F.lower(F.coalesce("upi", F.lit(""))).alias("u"))
    texts = moved.select("ledger_id", "cpk", "m").distinct()
    person = ["person_id", "name", "relationship"]
    exact = texts.where("m <> ''").join(who.withColumnRenamed("n", "m"), ["ledger_id", "m"]).select("ledger_id", "cpk", "m", *person, F.lit(0).alias("_r"))
    tokens = who.select("ledger_id", *person, F.explode(F.array_distinct(F.array("n", "u"))).alias("token")).where("length(token) >= 4").withColumn("gram", F.substring("token", 1, 4))
    runs = texts.select("ledger_id", "cpk", "m", F.explode(F.array_union(S.grams(F.col("cpk"), 4), S.grams(F.col("m"), 4))).alias("gram"))
    holds = F.col("cpk").contains(F.col("token")) | F.col("m").contains(F.col("token"))
    inside = runs.join(tokens, ["ledger_id", "gram"]).where(holds).select("ledger_id", "cpk", "m", *person, F.lit(1).alias("_r"))
    first = exact.union(inside).groupBy("ledger_id", "cpk", "m").agg(F.min_by(F.struct(*person), F.struct("_r", "name", "person_id")).alias("p"))
    sums = moved.join(first, ["ledger_id", "cpk", "m"], "left").groupBy("ledger_id", "p.person_id", "p.name", "p.relationship").agg(
        F.sum(F.when(F.col("debit_credit") == "debit", F.col("amount"))).alias("s"), F.sum(F.when(F.col("debit_credit") == "credit", F.col("amount"))).alias("r"), F.count("*").alias("count"), F.max("txn_date").alias("last_date")
    )
    zero = F.lit(0).cast("decimal(28,2)")
    return sums.select(
        "ledger_id", "person_id", "name", "relationship", S.money(F.col("s")).alias("sent"), S.money(F.col("r")).alias("received"), S.money(F.coalesce("r", zero) - F.coalesce("s", zero)).alias("net"), "count", "last_date"
    )


def merge_merchant_keys(keys: DataFrame, by: list[str]) -> DataFrame:
    """Map each key to the shortest key of five characters or more that is a word prefix of it.

    Prefixes at spaces are exploded and joined to the set of keys, so no pair of keys
    that share nothing ever meets.
    """
    distinct = keys.select(*by, "key").distinct()
    words = F.split("key", " ")
    prefixes = distinct.select(*by, "key", F.explode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, 1, n), " "))).alias("root"))
    roots = distinct.where(F.length("key") >= 5).withColumnRenamed("key", "root")
    found = prefixes.join(roots, [*by, "root"]).groupBy(*by, "key").agg(F.min_by("root", F.length("root")).alias("canonical"))
    return distinct.join(found, [*by, "key"], "left").withColumn("canonical", F.coalesce("canonical", "key"))


def top_merchants(rows: DataFrame, top: int = 8) -> DataFrame:
    """The largest merchants of each ledger and month on merged keys."""
    by = ["ledger_id", "month"]
    spend = _with_month(rows).where((F.col("debit_credit") == "debit") & S.is_spend(F.col("category")))
    spend = spend.select(*by, F.upper(F.coalesce("counterparty_key", "merchant")).alias("key"), "merchant", "amount").where("key is not null")
    merged = spend.join(merge_merchant_keys(spend, by), [*by, "key"])
    sums = merged.groupBy(*by, "canonical").agg(F.sum("amount").alias("t"), F.count("*").alias("count"))
    named = sums.join(_mode(merged, [*by, "canonical"], "merchant"), [*by, "canonical"], "left")
    place = Window.partitionBy(*by).orderBy(F.col("t").desc(), "canonical")
    ranked = named.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
    average = F.round((F.col("t").cast("double") / F.col("count")).cast("decimal(28,8)"), 2).cast("double")
    return ranked.select(*by, "rank", F.coalesce("merchant_mode", F.initcap("canonical")).alias("name"), S.money(F.col("t")).alias("total"), "count", average.alias("avg"))


def primary_account(txns: DataFrame, statements: DataFrame) -> DataFrame:
    """The busiest bank of each ledger, and the account to which its balances belong.

    A bank with two or more identified accounts is split, and the busiest is taken;
    otherwise statements without an account belong to the one that is known.
    """
    rows = txns.where("running_balance is not null").join(statements.select(F.col("id").alias("statement_id"), "bank_name", "account_ref"), "statement_id")
    banks = rows.groupBy("ledger_id", "bank_name").agg(F.count("*").alias("n"))
    bank = banks.groupBy("ledger_id").agg(F.min_by("bank_name", F.struct(-F.col("n"), F.col("bank_name"))).alias("bank_name"))
    known = rows.where("account_ref <> ''").groupBy("ledger_id", "bank_name", "account_ref").agg(F.count("*").alias("n"))
    accounts = known.groupBy("ledger_id", "bank_name").agg(F.min_by("account_ref", F.struct(-F.col("n"), F.col("account_ref"))).alias("account_ref"), F.count("*").alias("accounts"))
    out = bank.join(accounts, ["ledger_id", "bank_name"], "left")
    label = F.when(F.col("account_ref").isNotNull(), F.concat("bank_name", F.lit(" ····"), F.expr("right(account_ref, 4)"))).otherwise(F.col("bank_name"))
    return out.select("ledger_id", "bank_name", "account_ref", F.coalesce("accounts", F.lit(0)).alias("accounts"), label.alias("label"))


def balance_series(txns: DataFrame, statements: DataFrame, max_points: int = 240) -> DataFrame:
    """The last balance of each day of the primary account, evenly thinned to ``max_points``, the last day kept."""
    primary = primary_account(txns, statements)
    of = statements.select(F.col("id").alias("statement_id"), F.col("bank_name").alias("_b"), F.col("account_ref").alias("_a"))
    rows = txns.where("running_balance is not null").join(of, "statement_id").join(primary, "ledger_id")
    rows = rows.where((F.col("_b") == F.col("bank_name")) & ((F.col("accounts") <= 1) | (F.col("_a") == F.col("account_ref"))))
    days = rows.groupBy("ledger_id", "label", F.col("txn_date").alias("date")).agg(F.max_by("running_balance", "row_seq").cast("double").alias("balance"))
    n, i = F.count("*").over(Window.partitionBy("ledger_id")), F.row_number().over(Window.partitionBy("ledger_id").orderBy("date"))
    step = F.greatest(F.ceil(F.col("n") / max_points), F.lit(1))
    thinned = days.withColumn("n", n).withColumn("i", i).where((F.pmod(F.col("i") - 1, step) == 0) | (F.col("i") == F.col("n")))
    return thinned.select("ledger_id", F.col("label").alias("account"), "date", "balance")


def unexplained(rows: DataFrame) -> DataFrame:
    """Debits without a label or under Miscellaneous, per ledger and month."""
    open_ = (F.col("debit_credit") == "debit") & (F.col("annotation_id").isNull() | (F.col("category") == "Miscellaneous"))
    return _with_month(rows).groupBy("ledger_id", "month").agg(F.count(F.when(open_, 1)).alias("count"), S.money(F.sum(F.when(open_, F.col("amount")))).alias("total"))


def annotation_coverage(rows: DataFrame) -> DataFrame:
    return _with_month(rows).groupBy("ledger_id", "month").agg(F.countDistinct("id").alias("total"), F.countDistinct(F.when(F.col("annotation_id").isNotNull(), F.col("id"))).alias("annotated"))


#: What ``insight_summary`` nests, each a table by ledger (and month).
MARTS = ("verdict", "net", "subcategories", "recurring", "people", "merchants", "balance", "unexplained", "coverage")


def insight_summary(marts: dict[str, DataFrame], month: str | None = None) -> DataFrame:
    """Everything about one month of each ledger, and about the ledger as a whole, as one nested row.

    ``marts`` has the results of the operators under the names in ``MARTS``. ``month`` is the
    month that is told where a ledger has it; else, or without one, the ledger's latest is.
    Rows: ledger_id, month, prev_month, months, verdict and prev_verdict (zeros for a month
    without rows), categories by falling net spend with their subcategories, the three largest
    changes, recurring charges by falling amount, people by falling balance and what matched
    nobody, merchants, the balance series with its account, what is unexplained, and how
    many rows have labels.

    The marts are small beside the rows. They meet as tagged rows of one union and in one
    grouping by ledger, so one shuffle serves all; months are chosen within a ledger's arrays.
    """
    cells = None
    for name in MARTS:
        df = marts[name]
        tagged = df.select("ledger_id", F.struct(*[c for c in df.columns if c != "ledger_id"]).alias(name))
        cells = tagged if cells is None else cells.unionByName(tagged, allowMissingColumns=True)
    by = cells.groupBy("ledger_id").agg(*[F.collect_list(name).alias(name) for name in MARTS])
    by = by.withColumn("months", F.array_sort(F.transform("coverage", lambda x: x["month"])))
    chosen = F.element_at("months", -1)
    by = by.withColumn("month", F.when(F.array_contains("months", F.lit(month)), F.lit(month)).otherwise(chosen) if month else chosen)
    by = by.withColumn("prev_month", S.prev_month(F.col("month")))

    def of(name: str, when: str = "month"):
        return F.filter(name, lambda x: x["month"] == F.col(when))

    def ordered(rows, *keys):
        """``rows`` by some keys, which are functions of a row."""
        sorted_ = F.array_sort(F.transform(rows, lambda x: F.struct(*[k(x).alias(f"_{n}") for n, k in enumerate(keys)], x.alias("_x"))))
        return F.transform(sorted_, lambda x: x["_x"])

    fields = [f for f in marts["verdict"].columns if f not in ("ledger_id", "month")]
    told = lambda when: F.get(of("verdict", when), F.lit(0))
    zeros = F.struct(*[(F.lit(None).cast("double") if f == "kept_rate" else F.lit(0.0)).alias(f) for f in fields])
    plain = lambda when: F.when(told(when).isNotNull(), F.struct(*[told(when)[f].alias(f) for f in fields])).otherwise(zeros)
    by = by.withColumn("_now", of("net")).withColumn("_then", of("net", "prev_month")).withColumn("_subs", of("subcategories"))

    def net_of(rows: str, category):
        return F.coalesce(F.get(F.filter(rows, lambda y: y["category"] == category), F.lit(0))["net"], F.lit(0.0))

    def category(x):
        before = net_of("_then", x["category"])
        subs = ordered(F.filter("_subs", lambda y: (y["category"] == x["category"]) & y["subcategory"].isNotNull()), lambda y: -y["total"], lambda y: y["subcategory"])
        parts = F.transform(subs, lambda y: F.struct(y["subcategory"].alias("subcategory"), y["total"].alias("total"), y["count"].alias("count")))
        return F.struct(*[x[f].alias(f) for f in ("category", "gross", "net", "offsets", "count")], before.alias("prev_net"), F.round(x["net"] - before, 2).alias("delta"), parts.alias("subcategories"))

    names = F.array_distinct(F.transform(F.concat("_now", "_then"), lambda x: x["category"]))

    def change(c):
        now, then = net_of("_now", c), net_of("_then", c)
        return F.struct(c.alias("category"), F.round(now - then, 2).alias("delta"), now.alias("current"), then.alias("previous"))

    changes = ordered(F.filter(F.transform(names, change), lambda x: F.abs(x["delta"]) >= 1), lambda x: -F.abs(x["delta"]), lambda x: x["category"])
    nobody = F.get(F.filter("people", lambda x: x["person_id"].isNull()), F.lit(0))
    unmatched = F.struct(F.coalesce(nobody["sent"], F.lit(0.0)).alias("sent"), F.coalesce(nobody["received"], F.lit(0.0)).alias("received"), F.coalesce(nobody["count"], F.lit(0)).alias("count"))
    known = ordered(F.filter("people", lambda x: x["person_id"].isNotNull()), lambda x: -F.abs(x["net"]), lambda x: x["name"], lambda x: x["person_id"])
    series = F.transform(F.array_sort(F.transform("balance", lambda x: F.struct(x["date"].alias("date"), x["balance"].alias("balance")))), lambda x: x)
    one = lambda name, *cols: F.struct(*[F.coalesce(F.get(of(name), F.lit(0))[c], F.lit(0)).alias(c) for c in cols]).alias(name)
    return by.select(
        "ledger_id", "month", "prev_month", "months", plain("month").alias("verdict"), plain("prev_month").alias("prev_verdict"), F.slice(changes, 1, 3).alias("what_changed"),
        ordered(F.transform("_now", category), lambda x: -x["net"], lambda x: x["category"]).alias("categories"),
        ordered("recurring", lambda x: -x["amount"], lambda x: x["name"], lambda x: x["key"]).alias("recurring"), known.alias("people"), unmatched.alias("unmatched"),
        ordered(of("merchants"), lambda x: x["rank"]).alias("merchants"), F.get("balance", F.lit(0))["account"].alias("account"), series.alias("balance"),
        one("unexplained", "count", "total"), one("coverage", "total", "annotated").alias("annotation"),
    )
