"""Labels of nearest neighbours, their votes, and the scores that follow."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.thresholds import TRUSTED, Thresholds

def novelty_gate(neighbours: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    """Neighbours of queries whose best similarity reaches the floor, with ``best``."""
    best = F.max("similarity").over(Window.partitionBy("ledger_id", "query_id"))
    return neighbours.withColumn("best", best).where(F.col("best") >= th.similarity_floor)


def attach_donor_labels(neighbours: DataFrame, rows: DataFrame) -> DataFrame:
    """Neighbours with the donor's label, handle and description; unlabelled donors go."""
    label = rows.where("annotation_id is not null").select(F.col("id").alias("transaction_id"), "category", "subcategory", "merchant", "tags", "source", "vpa", "raw_description", "amount", "txn_date")
    return neighbours.join(label, "transaction_id")


def donor_identity() -> Column:
    name = F.lower(F.trim("merchant"))
    return F.when(F.col("vpa") != "", F.concat(F.lit("vpa:"), F.lower("vpa"))).when(name != "", F.concat(F.lit("merchant:"), name)).otherwise(
        F.concat(F.lit("desc:"), F.lower(F.trim(F.coalesce(F.nullif("raw_description", F.lit("")), "transaction_id"))))
    )


def dedup_donors(donors: DataFrame) -> DataFrame:
    """One donor for each query and identity, the nearest."""
    place = Window.partitionBy("ledger_id", "query_id", donor_identity()).orderBy(F.col("similarity").desc(), "transaction_id")
    return donors.withColumn("_n", F.row_number().over(place)).where("_n = 1").drop("_n")


def donor_weight(th: Thresholds) -> Column:
    return F.when(F.col("source").isin(*TRUSTED), 1.0).otherwise(th.machine_weight)


def weighted_vote(donors: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    """Winner, its share of the weight, and the trusted weight; ties to the first category by name."""
    by = ["ledger_id", "query_id"]
    weights = donors.where("category is not null").groupBy(*by, "category").agg(F.sum(donor_weight(th)).alias("w"), F.sum(F.when(F.col("source").isin(*TRUSTED), 1.0).otherwise(0.0)).alias("t"))
    return weights.groupBy(*by).agg(
        F.min_by("category", F.struct(-F.col("w"), F.col("category"))).alias("vote"), F.round(F.max("w") / F.sum("w"), 4).alias("vote_share"), F.sum("t").alias("trusted_weight")
    )


def _nearest() -> Column:
    return F.struct(-F.col("similarity"), F.col("transaction_id"))


def agreement_factor(donors: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    """(Share of donors with the nearest one's category) ** exponent, 1 if all agree."""
    by = Window.partitionBy("ledger_id", "query_id")
    top = F.min_by("category", _nearest()).over(by)
    share = donors.withColumn("_t", top).groupBy("ledger_id", "query_id").agg(F.avg(F.col("category").eqNullSafe(F.col("_t")).cast("double")).alias("s"))
    return share.select("ledger_id", "query_id", F.when(F.col("s") >= 1, 1.0).otherwise(F.pow("s", F.lit(th.agreement_exponent))).alias("agreement"))


def margin_factor(donors: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    """0.85 to 1 by how much farther the nearest donor of another category is.

    Similarities have six places, so gap and factor are exact decimals; the result is the double next to that.
    """
    by = Window.partitionBy("ledger_id", "query_id")
    top = F.min_by("category", _nearest()).over(by)
    exact = F.col("similarity").cast("decimal(10,6)")
    gap = donors.withColumn("_t", top).groupBy("ledger_id", "query_id").agg((F.max(exact) - F.max(F.when(~F.col("category").eqNullSafe(F.col("_t")), exact))).alias("g"))
    safe = F.lit(Decimal(str(th.margin_safe)))
    factor = (F.lit(Decimal("0.85")) + F.lit(Decimal("0.15")) * F.col("g") / safe).cast("double")
    return gap.select("ledger_id", "query_id", F.when(F.col("g").isNull() | (F.col("g") >= safe), 1.0).otherwise(factor).alias("margin"))


def rag_direct(donors: DataFrame, best: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    """Copy the nearest donor's label where it is trusted and near enough.

    ``donors`` are deduplicated; ``best`` (ledger_id, query_id, best) is the similarity of
    the nearest neighbour before that.
    """
    by = ["ledger_id", "query_id"]
    nearest = donors.groupBy(*by).agg(F.min_by(F.struct("category", "subcategory", "merchant", "tags", "source", "transaction_id"), _nearest()).alias("d"))
    out = nearest.join(best.where(F.col("best") >= th.rag_direct), by).where(F.col("d.source").isin(*TRUSTED))
    out = out.join(agreement_factor(donors, th), by).join(margin_factor(donors, th), by)
    score = F.round((F.col("best") * F.col("agreement") * F.col("margin")).cast("decimal(28,10)"), 4).cast("double")
    return out.select(*by, "d.category", "d.subcategory", "d.merchant", "d.tags", F.col("d.transaction_id").alias("donor_id"), score.alias("confidence"), F.lit("rag_direct").alias("source"))


def fewshot_examples(donors: DataFrame) -> DataFrame:
    """Neighbours of each query as examples, human labels first, with the most frequent category."""
    order = F.when(F.col("source") == "manual", 0).when(F.col("source") == "rule", 1).when(F.col("source") == "imported", 2).otherwise(9)
    example = F.struct(order.alias("o"), (-F.col("similarity")).alias("s"), "transaction_id", "raw_description", "category", "subcategory", "merchant", "source")
    by = ["ledger_id", "query_id"]
    lists = donors.groupBy(*by).agg(F.array_sort(F.collect_list(example)).alias("examples"))
    counts = donors.where("category is not null").groupBy(*by, "category").agg(F.count("*").alias("n"))
    mode = counts.groupBy(*by).agg(F.min_by(F.struct("category", "n"), F.struct(-F.col("n"), F.col("category"))).alias("m"))
    return lists.join(mode, by, "left").select(*by, "examples", F.col("m.category").alias("majority"), F.col("m.n").alias("majority_count"))


def neighbour_majority(donors: DataFrame) -> DataFrame:
    """Most frequent neighbour category, how many agree, and how many of these are trusted."""
    by = ["ledger_id", "query_id"]
    counts = donors.where("category is not null").groupBy(*by, "category").agg(F.count("*").alias("n"), F.count(F.when(F.col("source").isin(*TRUSTED), 1)).alias("t"))
    best = counts.groupBy(*by).agg(F.min_by(F.struct("category", "n", "t"), F.struct(-F.col("n"), F.col("category"))).alias("m"))
    return best.select(*by, F.col("m.category").alias("majority"), F.col("m.n").alias("agreeing"), F.col("m.t").alias("trusted_agreeing"))


def distinct_inference_requests(txns: DataFrame) -> DataFrame:
    """One request for each description and direction, and how many rows share the answer."""
    return txns.groupBy(F.lower(F.trim("raw_description")).alias("description"), "debit_credit").agg(F.count("*").alias("rows"), F.min("id").alias("first_id"))


def fan_out(txns: DataFrame, answers: DataFrame) -> DataFrame:
    """Give each row the answer to its request."""
    keyed = txns.withColumn("description", F.lower(F.trim("raw_description")))
    return keyed.join(answers, ["description", "debit_credit"], "left").drop("description")


def calibrated_dampening(counts: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    """Factor for each (source, category) with feedback: a Beta mean around the source's base."""
    base = F.when(F.col("source") == "llm", th.dampen_llm).when(F.col("source") == "rag_prompted", th.dampen_rag)
    alpha = 5.0 * base + F.col("confirmed") + 0.5 * F.col("refined")
    beta = 5.0 * (1.0 - base) + F.col("corrected")
    return counts.where(base.isNotNull()).select("source", "category", (alpha / (alpha + beta)).alias("dampening"))


def dampened(scored: DataFrame, dampening: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    """``dampened``: confidence times the factor of its source and category, four places."""
    out = scored.join(F.broadcast(dampening), ["source", "category"], "left")
    base = F.when(F.col("source") == "llm", th.dampen_llm).when(F.col("source") == "rag_prompted", th.dampen_rag).otherwise(1.0)
    value = F.round((F.col("confidence") * F.coalesce("dampening", base)).cast("decimal(28,10)"), 4).cast("double")
    return out.withColumn("dampened", value).drop("dampening")


def score_plain(predictions: DataFrame, dampening: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    """Confidence of predictions made without neighbours."""
    return dampened(predictions.withColumn("source", F.lit("llm")), dampening, th)


def score_prompted(predictions: DataFrame, dampening: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    """Confidence of predictions made with examples, capped off the examples and where donors split.

    ``predictions`` has example_categories (an array), vote_share and trusted_weight.
    """
    out = dampened(predictions.withColumn("source", F.lit("rag_prompted")), dampening, th)
    off = (F.size("example_categories") > 0) & ~F.array_contains("example_categories", F.col("category"))
    split = (F.col("trusted_weight") > 0) & (F.col("vote_share") < th.consensus_floor) & (F.col("confidence") < th.defer_llm)
    cap = F.when(off, F.least("dampened", F.lit(th.off_example_cap))).when(split, F.least("dampened", F.lit(th.defer_cap))).otherwise(F.col("dampened"))
    return out.withColumn("scored", cap).withColumn("cap", F.when(off, "off_example").when(split, "defer"))


def fuse_prior(scored: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    """Raise or cap ``scored`` by an established prior (prior_category, probability, established); adds fused and effect."""
    agree = F.col("prior_category") == F.col("category")
    up = F.greatest("scored", F.round("probability", 4))
    down = F.least("scored", F.lit(th.defer_cap))
    on = F.coalesce("established", F.lit(False))
    fused = F.when(on & agree, up).when(on, down).otherwise(F.col("scored"))
    effect = F.when(on & agree & (up > F.col("scored")), "rescue").when(on & ~agree & (down < F.col("scored")), "tighten").otherwise("neutral")
    return scored.withColumn("fused", fused).withColumn("effect", effect)
