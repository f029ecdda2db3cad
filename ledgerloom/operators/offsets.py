"""Money that came back, set against spending, under one capacity per debit.

Every offset against a debit uses up its amount. With ordered credits and running
sums C, what credit i takes from a capacity is min(cap, C_i) - min(cap, C_{i-1}), so
windows give what a loop over rows would.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.thresholds import NON_SPEND, OFFSET_TYPES

OUT = ["ledger_id", "credit_id", "debit_id", "month", "category", "amount"]
_MONEY = "decimal(28,6)"


def _clamp(amount: str, cap: str, keys: list[str], order: list[str]) -> Column:
    upto = F.sum(amount).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return F.least(F.col(cap), upto) - F.least(F.col(cap), upto - F.col(amount))


def offsets_links(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Linked credits, each capped at what its debit has left, with ``spend`` for debits that are spending."""
    side = lambda p: rows.select(*[F.col(c).alias(f"{p}_{c}") for c in ("id", "debit_credit", "amount", "txn_date", "category")])
    both = links.where(F.col("link_type").isin(*OFFSET_TYPES)).join(side("a"), F.col("txn_a") == F.col("a_id")).join(side("b"), F.col("txn_b") == F.col("b_id"))
    both = both.where(F.col("a_debit_credit") != F.col("b_debit_credit"))
    a_credit = F.col("a_debit_credit") == "credit"
    pick = lambda c, credit: F.when(a_credit if credit else ~a_credit, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}"))
    flat = both.select(
        "ledger_id", F.col("id").alias("link_id"), "created_at", pick("id", True).alias("credit_id"), pick("id", False).alias("debit_id"),
        S.month_of(pick("txn_date", True)).alias("month"), pick("category", False).alias("c"), pick("amount", True).alias("credit"), pick("amount", False).alias("cap"),
    )
    taken = flat.withColumn("amount", _clamp("credit", "cap", ["debit_id"], ["created_at", "link_id"]).cast(_MONEY))
    return taken.select("ledger_id", "credit_id", "debit_id", "month", S.spend_category(F.col("c")).alias("category"), "amount", S.is_spend(F.col("c")).alias("spend"))


def _left(debits: DataFrame, *taken: DataFrame) -> DataFrame:
    """``debits`` with ``left``: their amount less what ``taken`` took."""
    used = None
    for t in taken:
        part = t.select(F.col("debit_id").alias("id"), "amount")
        used = part if used is None else used.union(part)
    used = used.groupBy("id").agg(F.sum("amount").alias("_used"))
    zero = F.lit(0).cast(_MONEY)
    return debits.join(used, "id", "left").withColumn("left", F.greatest(F.col("amount") - F.coalesce("_used", zero), zero).cast(_MONEY)).drop("_used")


def _share(debits: DataFrame, credits: DataFrame) -> DataFrame:
    """What each credit gives to each debit of its group, none of whose debits another of the groups holds.

    A group's capacities shrink evenly, so its credits take from their sum in turn and each
    is dealt in proportion to what the debits had left. Amounts are whole millionths; what is
    lost to rounding down goes to the largest remainders, so the shares of a credit
    are exactly what it took.
    """
    totals = debits.groupBy("group_id").agg(F.sum("left").alias("total")).where("total > 0")
    taken = credits.join(totals, "group_id").withColumn("take", _clamp("value", "total", ["group_id"], ["txn_date", "id"])).where("take > 0")
    shares = taken.select("ledger_id", "group_id", F.col("id").alias("credit_id"), S.month_of(F.col("txn_date")).alias("month"), "take", "total").join(
        debits.where("left > 0").select("group_id", F.col("id").alias("debit_id"), "left", "category"), "group_id"
    )
    product = F.col("take").cast("decimal(19,0)") * F.col("left").cast("decimal(19,0)")
    dealt = shares.withColumn("_p", product).withColumn("_base", F.expr("_p div CAST(total AS DECIMAL(19,0))")).withColumn("_rest", F.col("_p") % F.col("total").cast("decimal(19,0)"))
    credit = Window.partitionBy("group_id", "credit_id")
    one_more = F.row_number().over(credit.orderBy(F.desc("_rest"), "debit_id")) <= F.col("take") - F.sum("_base").over(credit)
    amount = ((F.col("_base") + one_more.cast("long")).cast("decimal(22,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast(_MONEY)
    return dealt.select("ledger_id", "credit_id", "debit_id", "month", S.spend_category(F.col("category")).alias("category"), amount.alias("amount"))


def offsets_groups(rows: DataFrame, members: DataFrame, linked: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Credits of expense groups, shared over the group's spend debits by what these have left.

    Groups that share a debit are settled in the order of their ids, in waves: a group's
    turn comes when no earlier group that holds one of its debits is open, and all whose
    turn it is are settled together by windows. Groups that share none are all in the
    first wave; there are as many waves as the longest chain of groups that touch. ``keep``
    stores a wave's shares, which the next ones read.
    """
    inside = members.select("group_id", F.col("transaction_id").alias("id"), "txn_type").join(rows.select("id", "ledger_id", "amount", "debit_credit", "txn_date", "category"), "id")
    debits = inside.where((F.col("debit_credit") == "debit") & S.is_spend(F.col("category")))
    millionths = lambda c: (F.col(c) * 1_000_000).cast("long")
    debits = _left(debits, linked).select("group_id", "id", "category", millionths("left").alias("left"))
    credits = inside.where((F.col("debit_credit") == "credit") & F.col("txn_type").isin(*OFFSET_TYPES)).select("ledger_id", "group_id", "id", "txn_date", millionths("amount").alias("value"))
    turn = F.lag("group_id").over(Window.partitionBy("id").orderBy("group_id"))
    follows = keep(debits.select("group_id", turn.alias("before")).where("before < group_id").distinct())
    done = None
    while True:
        later = follows.select("group_id").distinct()
        last = follows.isEmpty()
        wave = keep(_share(*(df if last else df.join(later, "group_id", "left_anti") for df in (debits, credits))))
        done = wave if done is None else done.unionByName(wave)
        if last:
            return done
        used = wave.groupBy(F.col("debit_id").alias("id")).agg((F.sum("amount") * 1_000_000).cast("long").alias("used"))
        left = F.greatest(F.col("left") - F.coalesce("used", F.lit(0)), F.lit(0)).alias("left")
        debits = keep(debits.join(later, "group_id", "left_semi").join(used, "id", "left").select("group_id", "id", "category", left))
        credits = credits.join(later, "group_id", "left_semi")
        follows = keep(follows.join(later.select(F.col("group_id").alias("before")), "before", "left_semi"))


def used_credits(links: DataFrame, members: DataFrame, rows: DataFrame) -> DataFrame:
    """Credits that a link or a group has claimed, whether or not they offset anything."""
    grouped = members.where(F.col("txn_type").isin(*OFFSET_TYPES)).select(F.col("transaction_id").alias("id")).join(rows.where("debit_credit = 'credit'").select("id", "ledger_id"), "id")
    return links.select("ledger_id", F.col("credit_id").alias("id")).union(grouped.select("ledger_id", "id")).distinct()


def open_credits(rows: DataFrame, used: DataFrame) -> DataFrame:
    """Labelled credits nobody claimed that stand for money coming back."""
    refund = (F.col("category") == "Income") & (F.col("subcategory") == "Refund")
    back = rows.where((F.col("debit_credit") == "credit") & F.col("annotation_id").isNotNull() & (refund | ~F.col("category").isin(*NON_SPEND)))
    return back.join(used.select("id"), "id", "left_anti")


def settled_credits(rows: DataFrame, links: DataFrame, members: DataFrame) -> DataFrame:
    """Credits that any phase has consumed (ledger_id, id): linked, grouped, or labelled as money coming back."""
    used = used_credits(offsets_links(rows, links), members, rows)
    return used.union(open_credits(rows, used).select("ledger_id", "id")).distinct()


def offsets_labelled(credits: DataFrame) -> DataFrame:
    """Credits labelled with a spend category net it in full."""
    return credits.where("category <> 'Income'").select(
        "ledger_id", F.col("id").alias("credit_id"), F.lit(None).cast("string").alias("debit_id"), S.month_of(F.col("txn_date")).alias("month"), "category", F.col("amount").cast(_MONEY).alias("amount")
    )


def _latest_before(credits: DataFrame, debits: DataFrame, key: str) -> DataFrame:
    """Each credit with ``d``, the last debit of the same key on its day or before; one window, no pairs."""
    fields = F.struct("txn_date", "row_seq", "id", "category", "amount")
    both = credits.select("*", F.lit(1).alias("_side"), F.lit(None).cast(debits.select(fields.alias("x")).schema["x"].dataType).alias("_d")).unionByName(
        debits.select("ledger_id", key, "txn_date", "row_seq", "id", F.lit(0).alias("_side"), fields.alias("_d")), allowMissingColumns=True
    )
    so_far = Window.partitionBy("ledger_id", key).orderBy("txn_date", "_side", "row_seq").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("d", F.last("_d", ignorenulls=True).over(so_far)).where("_side = 1").drop("_side", "_d")


def offsets_refund_by_counterparty(rows: DataFrame, credits: DataFrame) -> DataFrame:
    """Refunds to the category of the last labelled debit of the same counterparty, if that is spending."""
    refunds = credits.where("category = 'Income' AND counterparty_key IS NOT NULL").select("ledger_id", "counterparty_key", "txn_date", "row_seq", "id", "amount")
    debits = rows.where("debit_credit = 'debit' AND annotation_id IS NOT NULL AND counterparty_key IS NOT NULL")
    found = _latest_before(refunds, debits, "counterparty_key").where(F.col("d").isNotNull() & S.is_spend(F.col("d.category")))
    return found.select(
        "ledger_id", F.col("id").alias("credit_id"), F.col("d.id").alias("debit_id"), S.month_of(F.col("txn_date")).alias("month"), S.spend_category(F.col("d.category")).alias("category"), F.col("amount").cast(_MONEY).alias("amount")
    )


def offsets_refund_by_amount(rows: DataFrame, credits: DataFrame, matched: DataFrame, *taken: DataFrame, days: int = 60) -> DataFrame:
    """Other refunds to the last spend debit of the same amount within ``days``, capped by what it has left."""
    rest = credits.where("category = 'Income'").join(matched.select(F.col("credit_id").alias("id")), "id", "left_anti")
    rest = rest.select("ledger_id", "amount", "txn_date", "row_seq", "id")
    debits = rows.where((F.col("debit_credit") == "debit") & S.is_spend(F.col("category")))
    found = _latest_before(rest, debits, "amount").where(F.col("d").isNotNull() & (F.datediff("txn_date", F.col("d.txn_date")) <= days))
    pairs = found.select("ledger_id", F.col("id").alias("credit_id"), F.col("d.id").alias("id"), F.col("d.category").alias("c"), F.col("d.amount").alias("amount"), "txn_date", F.col("amount").alias("credit"))
    capped = _left(pairs, *taken).withColumn("take", _clamp("credit", "left", ["id"], ["txn_date", "credit_id"]).cast(_MONEY)).where("take > 0")
    return capped.select("ledger_id", "credit_id", F.col("id").alias("debit_id"), S.month_of(F.col("txn_date")).alias("month"), S.spend_category(F.col("c")).alias("category"), F.col("take").alias("amount"))


def spend_offsets(rows: DataFrame, links: DataFrame, members: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> dict[str, DataFrame]:
    """All phases by name, and ``all`` of them (ledger_id, month, category, amount).

    ``keep`` stores the phases that later ones read again, each one row a credit or share;
    without it they are computed as often as they are read.
    """
    linked = keep(offsets_links(rows, links))
    grouped = offsets_groups(rows, members, linked, keep)
    used = used_credits(linked, members, rows)
    credits = keep(open_credits(rows, used))
    labelled = offsets_labelled(credits)
    by_key = keep(offsets_refund_by_counterparty(rows, credits))
    by_amount = offsets_refund_by_amount(rows, credits, by_key, linked, grouped)
    spent = linked.where("spend AND amount > 0").select(*OUT)
    out = {"links": linked, "groups": grouped, "labelled": labelled, "by_counterparty": by_key, "by_amount": by_amount}
    every = spent
    for part in (grouped, labelled, by_key, by_amount):
        every = every.union(part.select(*OUT))
    return out | {"all": every.select("ledger_id", "month", "category", "amount")}
