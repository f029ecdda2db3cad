"""Review and corrections, as batch merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import classify_feedback
from ledgerloom.thresholds import MACHINE, MODEL, REVIEWABLE, Thresholds

FIELDS = ("category", "subcategory", "merchant", "tags", "confidence")


def review_queue(rows: DataFrame, top: int | None = None, th: Thresholds = Thresholds()) -> DataFrame:
    """Uncertain machine labels of each ledger, by doubt times the size of the money."""
    open_ = rows.where(F.col("source").isin(*REVIEWABLE) & (F.col("confidence") < th.confidence))
    score = F.round((1 - F.col("confidence")) * F.log1p(F.abs(F.col("amount").cast("double"))), 8)
    place = Window.partitionBy("ledger_id").orderBy(F.col("priority").desc(), "annotated_at", "id")
    out = open_.withColumn("priority", score).withColumn("rank", F.row_number().over(place))
    return out.where(F.col("rank") <= top) if top else out


def apply_corrections(anns: DataFrame, edits: DataFrame) -> DataFrame:
    """Set the fields that an edit sends, null included; the source turns manual, the first one is kept.

    ``edits`` has annotation_id, sent (an array of field names), and the fields. At most
    one edit an annotation; others are unchanged. An edit that sends nothing confirms:
    confidence 1.
    """
    e = edits.select(F.col("annotation_id").alias("id"), "sent", *[F.col(f).alias(f"_{f}") for f in FIELDS])
    out = anns.join(e, "id", "left")
    edited = F.col("sent").isNotNull()
    for f in FIELDS:
        out = out.withColumn(f, F.when(F.array_contains("sent", f), F.col(f"_{f}")).otherwise(F.col(f)))
    out = out.withColumn("confidence", F.when(edited & ~F.array_contains("sent", "confidence"), 1.0).otherwise(F.col("confidence")))
    out = out.withColumn("original_source", F.when(edited & (F.col("source") != "manual"), F.coalesce("original_source", "source")).otherwise(F.col("original_source")))
    return out.withColumn("source", F.when(edited, "manual").otherwise(F.col("source"))).select(*anns.columns)


def feedback_counts(events: DataFrame) -> DataFrame:
    """Confirmed, refined and corrected per source and category, of labels that a model made."""
    n = lambda k: F.count(F.when(F.col("feedback") == k, 1)).alias(k)
    return events.where(F.col("source").isin(*MODEL)).groupBy("source", "category").agg(n("confirmed"), n("refined"), n("corrected"))


def merge_feedback(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored counts plus new ones."""
    return stored.unionByName(new).groupBy("source", "category").agg(*[F.sum(c).alias(c) for c in ("confirmed", "refined", "corrected")])


def similar_candidates(rows: DataFrame, donors: DataFrame, similar: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    """Machine labels near a corrected row by vector, those that differ first.

    ``donors`` are rows with their label; ``similar`` has query_id, transaction_id,
    similarity, a bounded number a query. Rows of the same counterparty are linked by
    :func:`similar_groups`, not in pairs.
    """
    near = similar.where(F.col("similarity") >= th.apply_similar_floor).select(F.col("query_id").alias("donor_id"), F.col("transaction_id").alias("id"), "similarity")
    d = donors.select(F.col("id").alias("donor_id"), F.col("category").alias("_c"), F.col("subcategory").alias("_s"))
    target = rows.where(F.col("source").isin(*MACHINE)).select("id", "category", "subcategory", "source")
    out = near.join(d, "donor_id").join(target, "id")
    differs = ~(F.col("category").eqNullSafe(F.col("_c")) & F.col("subcategory").eqNullSafe(F.col("_s")))
    place = Window.partitionBy("donor_id").orderBy(differs.desc(), F.col("similarity").desc(), "id")
    return out.select("donor_id", "id", "category", "source", "similarity", differs.alias("differs"), F.row_number().over(place).alias("rank"))


def similar_groups(rows: DataFrame, donors: DataFrame) -> DataFrame:
    """Corrected rows and machine labels of the same counterparty, one row each: the group's keys, id, part, label.

    Every donor of a group and every candidate in it are a link; groups that lack either
    stay out. No pair is listed, so a busy counterparty costs as many rows as it has.
    """
    keys = ["ledger_id", "counterparty_key"]
    label = [*keys, "id", "category", "subcategory"]
    part = lambda df, name: df.where("counterparty_key is not null").select(*label, F.lit(name).alias("part"))
    both = part(donors, "donor").unionByName(part(rows.where(F.col("source").isin(*MACHINE)), "candidate"))
    full = both.groupBy(*keys).agg(F.countDistinct("part").alias("_n")).where("_n = 2").select(*keys)
    return both.join(full, keys, "left_semi")


def apply_to_similar(anns: DataFrame, picks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Copy donors' labels to the machine labels picked for them: annotations after, and feedback events.

    ``picks`` has donor_id and id, transactions; human labels are skipped.
    """
    label = anns.select(F.col("transaction_id").alias("donor_id"), *[F.col(f).alias(f"_{f}") for f in ("category", "subcategory", "merchant", "tags")])
    machine = anns.where(F.col("source").isin(*MACHINE)).select(F.col("transaction_id").alias("id"), F.col("id").alias("annotation_id"), *FIELDS, "source")
    todo = picks.join(label, "donor_id").join(machine, "id")
    yes = F.lit(True)
    old = {f: F.col(f) for f in ("category", "subcategory", "merchant", "tags")}
    new = {f: F.col(f"_{f}") for f in ("category", "subcategory", "merchant", "tags")}
    events = todo.select("source", "category", classify_feedback(old, new, {f: yes for f in new}).alias("feedback"))
    edits = todo.select("annotation_id", F.array(*map(F.lit, FIELDS)).alias("sent"), *[F.col(f"_{f}").alias(f) for f in new], F.lit(1.0).alias("confidence"))
    return apply_corrections(anns, edits), events


def resolve_category_ids(anns: DataFrame, categories: DataFrame) -> DataFrame:
    """Ids of names: categories among the top ones, subcategories within theirs; unknown ones null."""
    top = F.broadcast(categories.where("parent_id is null").select(F.col("name").alias("category"), F.col("id").alias("category_id")))
    sub = F.broadcast(categories.where("parent_id is not null").select(F.col("parent_id").alias("category_id"), F.col("name").alias("subcategory"), F.col("id").alias("subcategory_id")))
    return anns.drop("category_id", "subcategory_id").join(top, "category", "left").join(sub, ["category_id", "subcategory"], "left")


def relabel(anns: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rename categories in bulk: mapping(category, subcategory, new_category, new_subcategory); a null subcategory maps all."""
    m = F.broadcast(mapping.select(F.col("category").alias("_c"), F.col("subcategory").alias("_s"), "new_category", "new_subcategory"))
    out = anns.join(m, (F.col("category") == F.col("_c")) & (F.col("_s").isNull() | F.col("subcategory").eqNullSafe(F.col("_s"))), "left")
    out = out.withColumn("subcategory", F.when(F.col("_c").isNotNull(), F.coalesce("new_subcategory", "subcategory")).otherwise(F.col("subcategory")))
    return out.withColumn("category", F.coalesce("new_category", "category")).select(*anns.columns)
