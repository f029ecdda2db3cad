"""From rows of statement tables to transactions verified against their running balance."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S

#: Words of a header cell by role, in the order in which roles claim a cell.
ROLES: list[tuple[str, tuple[str, ...]]] = [
    ("debit", ("withdrawal", "debit", "dr amount", "paid out")),
    ("credit", ("deposit", "credit", "cr amount", "paid in")),
    ("balance", ("balance",)),
    ("date", ("date",)),
    ("drcr", ("dr/cr", "cr/dr", "dr / cr", "type")),
    ("description", ("description", "particulars", "narration", "remarks", "transaction details", "details")),
    ("amount", ("amount", "amt")),
]
TOLERANCE = 0.011
MIN_VERIFIED, MIN_TRANSACTIONS = 0.8, 3
_MONEY = "decimal(18,2)"
MAP = "struct<" + ",".join(f"{r}:int" for r, _ in ROLES) + ",width:int>"


def _plain(words: str) -> str:
    """Words as a pattern for themselves."""
    return re.sub(r"([^\w\s/])", r"\\\1", words)


def map_header(cells: Column, roles: list[tuple[str, tuple[str, ...]]] = ROLES) -> Column:
    """The column of each role if a row is a header, else null; ``roles`` are the words of each in order.

    Cells claim roles from left to right, each the first free one whose words it holds;
    a "value date" is no date. A header needs a date, a description and an amount.
    """
    start = F.struct(*[F.lit(None).cast("int").alias(r) for r, _ in ROLES], F.lit(0).alias("width"))

    # cleaned once, for every role asks for the text again
    cleaned = F.transform(cells, lambda raw: F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(raw, F.lit(""))), "\n", " "), "[^a-z/ ]", "")))

    def claim(acc: Column, text: Column) -> Column:
        role = None
        for name, words in roles:
            holds = text.rlike("|".join(map(_plain, words)))
            if name == "date":
                holds = holds & ~text.contains("value")
            test = acc[name].isNull() & holds
            role = F.when(test, name) if role is None else role.when(test, name)
        return F.struct(*[F.when(role.eqNullSafe(F.lit(n)), acc["width"]).otherwise(acc[n]).alias(n) for n, _ in ROLES], (acc["width"] + 1).alias("width"))

    found = F.aggregate(cleaned, start, claim)
    usable = found["date"].isNotNull() & found["description"].isNotNull() & (found["debit"].isNotNull() | found["credit"].isNotNull() | found["amount"].isNotNull())
    words = dict(roles)
    if not {"date", "description"} <= set(words):
        return F.lit(None).cast(MAP)
    holds = lambda role: F.exists(cells, lambda c: F.lower(c).rlike("|".join(map(_plain, words[role]))))
    return F.when(holds("date") & holds("description"), F.when(usable, found))  # most rows fail the first test


def carry_header(rows: DataFrame, roles: list[tuple[str, tuple[str, ...]]] = ROLES) -> DataFrame:
    """Data rows with ``map``, the latest header before them in the document; rows before any go."""
    order = Window.partitionBy("doc_id").orderBy("table_no", "row_no")
    mapped = rows.withColumn("_h", map_header(F.col("cells"), roles))
    return mapped.withColumn("map", F.last("_h", ignorenulls=True).over(order)).where("_h is null and map is not null").drop("_h")


def _cell(role: str) -> Column:
    return F.coalesce(F.get("cells", F.col(f"map.{role}")), F.lit(""))


def classify_rows(rows: DataFrame) -> DataFrame:
    """Each row as "entry", "more" (a wrapped description) or neither, with its values."""
    amount = lambda role: F.when(F.col(f"map.{role}").isNotNull(), S.parse_amount(_cell(role)))
    out = rows.select(
        "doc_id", "ledger_id", "table_no", "row_no", S.parse_statement_date(_cell("date")).alias("txn_date"), F.trim(F.regexp_replace(_cell("description"), r"\s+", " ")).alias("description"),
        amount("debit").alias("d"), amount("credit").alias("c"), amount("amount").alias("a"), amount("balance")["value"].alias("balance"), F.when(F.col("map.drcr").isNotNull(), F.lower(F.trim(_cell("drcr")))).alias("mark"),
    )
    from_a = F.coalesce("a.direction", F.when(F.col("mark").startswith("cr"), "credit").when(F.col("mark").startswith("dr"), "debit"))
    value = F.when(F.col("d.value") > 0, F.col("d.value")).when(F.col("c.value") > 0, F.col("c.value")).when(F.col("a.value") > 0, F.col("a.value"))
    direction = F.when(F.col("d.value") > 0, "debit").when(F.col("c.value") > 0, "credit").otherwise(from_a)
    none = F.col("d").isNull() & F.col("c").isNull() & F.col("a").isNull()
    kind = F.when(F.col("txn_date").isNotNull() & value.isNotNull(), "entry").when(F.col("txn_date").isNull() & (F.col("description") != "") & none, "more")
    return out.select("doc_id", "ledger_id", "table_no", "row_no", kind.alias("kind"), "txn_date", "description", F.when(kind == "entry", value).alias("amount"), F.when(kind == "entry", direction).alias("direction"), "balance")


def merge_continuations(classified: DataFrame) -> DataFrame:
    """Entries, with the text of the wrapped rows that follow them."""
    order = Window.partitionBy("doc_id").orderBy("table_no", "row_no")
    island = F.sum(F.when(F.col("kind") == "entry", 1).otherwise(0)).over(order)
    rows = classified.where("kind is not null").withColumn("seq", island).where("seq > 0")
    first = lambda c: F.max(F.when(F.col("kind") == "entry", F.col(c))).alias(c)
    texts = F.array_sort(F.collect_list(F.struct("table_no", "row_no", "description")))
    return rows.groupBy("doc_id", "ledger_id", "seq").agg(F.trim(F.array_join(F.transform(texts, lambda t: t["description"]), " ")).alias("description"), first("txn_date"), first("amount"), first("direction"), first("balance"))


def _by(*keys: str) -> Window:
    return Window.partitionBy("doc_id", *keys).orderBy("seq")


def infer_direction(entries: DataFrame, *keys: str) -> DataFrame:
    """Fill an unknown direction from the change of the balance against the row before."""
    before = F.lag("balance").over(_by(*keys))
    guess = F.when(F.col("balance").isNotNull() & before.isNotNull(), F.when(F.col("balance") >= before, "credit").otherwise("debit"))
    return entries.withColumn("direction", F.coalesce("direction", guess))


def _checked(entries: DataFrame, *keys: str) -> DataFrame:
    before = F.lag("balance").over(_by(*keys))
    change = F.when(F.col("direction") == "credit", F.col("amount")).otherwise(-F.col("amount"))
    known = F.col("balance").isNotNull() & before.isNotNull() & F.col("direction").isNotNull()
    day = F.lag("txn_date").over(_by(*keys))
    return entries.withColumn("_ok", F.when(known, F.abs(F.col("balance") - before - change) <= TOLERANCE)).withColumn("_up", F.when(day.isNotNull(), day <= F.col("txn_date")))


def chain_score(entries: DataFrame, *keys: str) -> DataFrame:
    """Share of adjacent balances that the amounts explain, how many were checked, and of dates in order."""
    out = _checked(entries, *keys).groupBy("doc_id", "ledger_id", *keys).agg(F.avg(F.col("_ok").cast("double")).alias("chain"), F.count("_ok").alias("checks"), F.avg(F.col("_up").cast("double")).alias("dates"))
    return out.withColumn("chain", F.coalesce("chain", F.lit(0.0))).withColumn("dates", F.coalesce("dates", F.lit(1.0)))


def date_order_score(entries: DataFrame) -> DataFrame:
    return chain_score(entries).select("doc_id", "dates")


def resolve_variant(entries: DataFrame) -> DataFrame:
    """The best of four readings of each document, and its rows: as printed or reversed, as labelled or swapped.

    The share of explained balances decides, then that of dates in order, then the
    order of the readings. A row's neighbours before and after in print are all that the four
    readings need, so one pass over a document's rows scores them side by side, and only
    the best is made.
    """
    order, whole = _by(), Window.partitionBy("doc_id")
    unknown = F.lit(None).cast("string")
    swapped = F.when(F.col("direction") == "debit", "credit").when(F.col("direction") == "credit", "debit").otherwise(unknown)
    out = entries.withColumns({"_b0": F.lag("balance").over(order), "_b2": F.lead("balance").over(order), "_d0": F.lag("txn_date").over(order), "_d2": F.lead("txn_date").over(order)})
    guess = lambda n: F.when(F.col("balance").isNotNull() & F.col(f"_b{n}").isNotNull(), F.when(F.col("balance") >= F.col(f"_b{n}"), "credit").otherwise("debit"))
    read = {0: F.coalesce("direction", guess(0)), 1: F.coalesce(swapped, guess(0)), 2: F.coalesce("direction", guess(2)), 3: F.coalesce(swapped, guess(2))}
    out = out.withColumns({f"_r{v}": c for v, c in read.items()})
    change = lambda v: F.when(F.col(f"_r{v}") == "credit", F.col("amount")).otherwise(-F.col("amount"))
    known = lambda v: F.col("balance").isNotNull() & F.col(f"_b{v // 2 * 2}").isNotNull() & F.col(f"_r{v}").isNotNull()
    out = out.withColumns({f"_ok{v}": F.when(known(v), (F.abs(F.col("balance") - F.col(f"_b{v // 2 * 2}") - change(v)) <= TOLERANCE).cast("double")) for v in read})
    out = out.withColumns({f"_up{n}": F.when(F.col(f"_d{n}").isNotNull(), (F.col(f"_d{n}") <= F.col("txn_date")).cast("double")) for n in (0, 2)})
    score = lambda v: F.struct((-F.coalesce(F.avg(f"_ok{v}").over(whole), F.lit(0.0))).alias("chain"), (-F.coalesce(F.avg(f"_up{v // 2 * 2}").over(whole), F.lit(1.0))).alias("dates"), F.lit(v).alias("variant"), F.count(f"_ok{v}").over(whole).alias("checks"))
    out = out.withColumns({f"_s{v}": score(v) for v in read} | {"_last": F.max("seq").over(whole)})
    out = out.withColumn("_best", F.array_min(F.array(*[f"_s{v}" for v in read])))
    variant = F.col("_best.variant")
    direction = F.when(variant == 0, F.col("_r0")).when(variant == 1, F.col("_r1")).when(variant == 2, F.col("_r2")).otherwise(F.col("_r3"))
    changed = {"direction": direction, "seq": F.when(variant >= 2, F.col("_last") + 1 - F.col("seq")).otherwise(F.col("seq"))}
    return out.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in entries.columns], variant.alias("variant"), (-F.col("_best.chain")).alias("verified"), F.col("_best.checks").alias("checks"))


def confidence_gate(resolved: DataFrame) -> DataFrame:
    """Per document whether its rows may enter the ledger."""
    out = resolved.groupBy("doc_id", "ledger_id").agg(F.count("direction").alias("transactions"), F.count("balance").alias("balances"), F.max("verified").alias("verified"), F.max("checks").alias("checks"))
    ok = (F.col("transactions") >= MIN_TRANSACTIONS) & (F.col("balances") > 0) & (F.col("checks") > 0) & (F.col("verified") >= MIN_VERIFIED)
    return out.withColumn("accepted", ok)


#: Layout tables. kind "fixed" names the columns by number, from 0; "header" finds them by a header's words. sign: "columns" (a debit and a
#: credit column), "mark" (one amount with Dr or Cr beside or in another column), "signed" (a minus is a debit).
LAYOUT = "layout string, layout_order int, kind string, width int, date_pattern string, date int, description int, debit int, credit int, amount int, drcr int, balance int, sign string"
WORDS = "role string, role_order int, word string"
#: The layouts that are known, tried in this order where they fit equally many rows.
LAYOUTS: list[tuple] = [
    ("six columns", 0, "fixed", 6, r"^\d{1,2}\s+\w{3},\s+\d{4}$", 0, 1, 3, 4, None, None, 5, "columns"),
    ("header", 1, "header", None, None, None, None, None, None, None, None, None, None),
]


def default_layouts(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The known layouts and header words as tables."""
    words = [(role, n, word) for n, (role, own) in enumerate(ROLES) for word in own]
    return spark.createDataFrame(LAYOUTS, LAYOUT), spark.createDataFrame(words, WORDS)


def _fixed(rows: DataFrame, layouts: list[Row]) -> DataFrame:
    """Rows that fit a layout whose columns are known, read by it; a row may fit several."""
    kinds = dict(f.split() for f in LAYOUT.split(", "))
    told = F.array(*[F.struct(*[F.lit(r[c]).cast(kind).alias(c) for c, kind in kinds.items()]) for r in layouts])
    met = rows.select("*", F.explode(told).alias("_l")).where(F.size("cells") >= F.col("_l.width"))
    cell = lambda role: F.trim(F.coalesce(F.get("cells", F.col(f"_l.{role}")), F.lit("")))
    met = met.where(F.rlike(cell("date"), F.col("_l.date_pattern")))
    number = lambda role: S.parse_amount(cell(role))
    met = met.withColumns({"_d": number("debit"), "_c": number("credit"), "_a": number("amount"), "_mark": F.lower(cell("drcr"))})
    columns = F.col("_l.sign") == "columns"
    value = F.when(columns, F.when(cell("debit") != "", F.col("_d.value")).otherwise(F.col("_c.value"))).otherwise(F.col("_a.value"))
    mark = F.coalesce("_a.direction", F.when(F.col("_mark").startswith("cr"), "credit").when(F.col("_mark").startswith("dr"), "debit"))
    sign = F.when(cell("amount").startswith("-"), "debit").otherwise("credit")
    direction = F.when(columns, F.when(cell("debit") != "", "debit").otherwise("credit")).when(F.col("_l.sign") == "mark", mark).otherwise(sign)
    balance = F.regexp_replace(cell("balance"), ",", "").try_cast(_MONEY)
    out = met.select(
        *[c for c in rows.columns if c != "cells"], F.col("_l.layout").alias("layout"), F.col("_l.layout_order").alias("layout_order"), S.parse_statement_date(F.regexp_replace(cell("date"), r"\s+", " ")).alias("txn_date"),
        F.regexp_replace(cell("description"), "\n", " ").alias("description"), value.alias("amount"), direction.alias("direction"), balance.alias("balance"),
    )
    return out.where("txn_date is not null and amount is not null")


def fixed_layout_rows(rows: DataFrame, layouts: DataFrame | None = None) -> DataFrame:
    """Rows of the layouts whose columns are known (by default the dedicated one of six columns), of each the first that fits."""
    known = [Row(**dict(zip([f.split()[0] for f in LAYOUT.split(", ")], r, strict=True))) for r in LAYOUTS] if layouts is None else layouts.orderBy("layout_order", "layout").collect()
    found = _fixed(rows.select("doc_id", "table_no", "row_no", "cells"), [r for r in known if r.kind == "fixed"])
    first = Window.partitionBy("doc_id", "table_no", "row_no").orderBy("layout_order", "layout")
    found = found.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return found.select("doc_id", "table_no", "row_no", "txn_date", "amount", F.col("direction").alias("debit_credit"), F.col("description").alias("raw_description"), F.col("balance").alias("running_balance"))


def read_layouts(rows: DataFrame, layouts: DataFrame | None = None, words: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Entries of each document by the layout that fits most of its rows: layout, doc_id, ledger_id, seq, description, txn_date, amount, direction, balance.

    ``layouts`` and ``words`` are tables like those of ``default_layouts``, which they default
    to; they are small and come to the driver. Of layouts that fit equally many rows the first by
    layout_order is taken; a document that none fits has no entries. Wrapped descriptions are
    known under headers alone. ``keep`` stores the parsed rows, which are read twice.
    """
    spark = rows.sparkSession
    default = default_layouts(spark)
    known = (default[0] if layouts is None else layouts).orderBy("layout_order", "layout").collect()
    said: dict[str, list[str]] = {}
    for r in (default[1] if words is None else words).orderBy("role_order", "role", "word").collect():
        said.setdefault(r.role, []).append(r.word.lower())
    entry = ["doc_id", "ledger_id", "seq", "description", "txn_date", "amount", "direction", "balance", "layout", "layout_order"]
    parts = []
    fixed = [r for r in known if r.kind == "fixed"]
    if fixed:
        place = Window.partitionBy("doc_id", "layout").orderBy("table_no", "row_no")
        parts.append(_fixed(rows.select("doc_id", "ledger_id", "table_no", "row_no", "cells"), fixed).withColumn("seq", F.row_number().over(place).cast("long")).select(*entry))
    for r in known:
        if r.kind == "header":
            read = merge_continuations(keep(classify_rows(carry_header(rows, [(k, tuple(v)) for k, v in said.items()]))))
            parts.append(read.withColumns({"layout": F.lit(r.layout), "layout_order": F.lit(r.layout_order)}).select(*entry))
    if not parts:
        raise ValueError("no layout is given")
    every = keep(reduce(DataFrame.unionByName, parts))
    fits = every.groupBy("doc_id", "layout", "layout_order").agg(F.count("*").alias("n"))
    best = fits.groupBy("doc_id").agg(F.min_by("layout", F.struct(-F.col("n"), F.col("layout_order"), F.col("layout"))).alias("layout"))
    return every.join(best, ["doc_id", "layout"]).drop("layout_order")


def chain_order(parsed: DataFrame) -> DataFrame:
    """Rows of each document oldest first: by its first and last day, else in the direction that more balances verify.

    ``parsed`` has doc_id, seq, txn_date, amount, direction, balance.
    """
    ends = parsed.groupBy("doc_id").agg(F.min_by("txn_date", "seq").alias("_a"), F.max_by("txn_date", "seq").alias("_z"), F.max("seq").alias("_n"), F.min("seq").alias("_m"))
    back = parsed.join(ends.select("doc_id", "_n", "_m"), "doc_id").withColumn("seq", F.col("_n") + F.col("_m") - F.col("seq")).drop("_n", "_m")
    ok = lambda df, name: _checked(df).groupBy("doc_id").agg(F.count(F.when(F.col("_ok"), 1)).alias(name))
    ways = ends.join(ok(parsed, "_f"), "doc_id").join(ok(back, "_r"), "doc_id")
    turn = (F.col("_a") > F.col("_z")) | ((F.col("_a") == F.col("_z")) & (F.col("_r") > F.col("_f")))
    out = parsed.join(ways.select("doc_id", "_n", "_m", turn.alias("reversed")), "doc_id")
    return out.withColumn("seq", F.when(F.col("reversed"), F.col("_n") + F.col("_m") - F.col("seq")).otherwise(F.col("seq"))).drop("_n", "_m")


def split_balance_artifacts(ordered: DataFrame) -> DataFrame:
    """Opening and closing balance of each document, from artifact rows or else from the chain.

    ``ordered`` has doc_id, seq (oldest first), raw_description, amount, direction, balance.
    """
    rows = ordered.withColumn("_k", S.balance_artifact(F.col("raw_description")))
    own = F.coalesce("balance", "amount")
    before = F.col("balance") + F.when(F.col("direction") == "debit", F.col("amount")).otherwise(-F.col("amount"))
    plain = F.col("_k").isNull()
    sums = rows.groupBy("doc_id").agg(
        F.max_by(own, F.when(F.col("_k") == "opening", F.col("seq"))).alias("o"), F.max_by(own, F.when(F.col("_k") == "closing", F.col("seq"))).alias("c"),
        F.min_by(F.struct(before.alias("v")), F.when(plain, F.col("seq"))).alias("io"), F.max_by("balance", F.when(plain & F.col("balance").isNotNull(), F.col("seq"))).alias("ic"), F.count(F.when(plain, 1)).alias("transactions"),
    )
    return sums.select("doc_id", F.coalesce("o", "io.v").alias("opening_balance"), F.coalesce("c", "ic").alias("closing_balance"), "transactions")


def statement_periods(txns: DataFrame) -> DataFrame:
    out = txns.groupBy("statement_id").agg(F.min("txn_date").alias("period_start"), F.max("txn_date").alias("period_end"))
    return out.withColumn("statement_month", S.month_of(F.col("period_start")))


def continuity_warnings(statements: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Statements whose balance does not go on from the nearest one before, or into the nearest after.

    Neighbours are of the same bank and account, unknown accounts among themselves. Both
    neighbours come from one window each over the account's statements, no pairs.
    """
    keys = ["ledger_id", "bank_name", "account_ref"]
    both = statements.select(*keys, "id", F.col("period_start").alias("at"), F.lit(1).alias("side"), F.lit(None).cast(_MONEY).alias("v"), F.col("opening_balance").alias("own"), F.lit(None).cast("string").alias("n"))
    ends = statements.select(*keys, F.lit(None).cast("string").alias("id"), F.date_add("period_end", 1).alias("at"), F.lit(0).alias("side"), F.col("closing_balance").alias("v"), F.lit(None).cast(_MONEY).alias("own"), F.col("id").alias("n"))
    past = Window.partitionBy(*keys).orderBy("at", "side", "n").rowsBetween(Window.unboundedPreceding, 0)
    prev = both.union(ends).withColumn("_p", F.last(F.when(F.col("side") == 0, F.struct("v", "n")), ignorenulls=True).over(past)).where("side = 1 and _p is not null")
    starts = statements.select(*keys, F.lit(None).cast("string").alias("id"), F.date_sub("period_start", 1).alias("at"), F.lit(0).alias("side"), F.col("opening_balance").alias("v"), F.lit(None).cast(_MONEY).alias("own"), F.col("id").alias("n"))
    here = statements.select(*keys, "id", F.col("period_end").alias("at"), F.lit(1).alias("side"), F.lit(None).cast(_MONEY).alias("v"), F.col("closing_balance").alias("own"), F.lit(None).cast("string").alias("n"))
    future = Window.partitionBy(*keys).orderBy(F.col("at").desc(), "side", F.col("n").desc()).rowsBetween(Window.unboundedPreceding, 0)
    after = here.union(starts).withColumn("_p", F.last(F.when(F.col("side") == 0, F.struct("v", "n")), ignorenulls=True).over(future)).where("side = 1 and _p is not null")
    gap = F.abs(F.col("own") - F.col("_p.v")) > tolerance
    one = lambda df, kind: df.where(gap).select("ledger_id", "id", F.lit(kind).alias("kind"), F.col("_p.n").alias("neighbour"), F.col("own").cast("double").alias("own"), F.col("_p.v").cast("double").alias("other"))
    return one(prev, "opening").union(one(after, "closing"))
