"""Mixing sources to target weights by hash-threshold histograms (operator 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, EPOCHS = 1.5, 2.0
#: A hash has 60 bits; each level of the histogram looks at 12 more of them.
BITS, LEVELS = 12, 5


def word_count(text):
    """Runs of anything but ASCII white space; a null text has none."""
    return F.coalesce(F.size(F.split(F.trim(F.translate(text, "\t\n\x0b\x0c\r", "     ")), " +")).cast("long") - F.when(F.trim(F.translate(text, "\t\n\x0b\x0c\r", "     ")) == "", 1).otherwise(0), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """``sizes(source, source_size)``, one row a source, to its target.

    Sources in code point order, null last, weigh ``weights`` in turn and share
    ``share`` times all sizes; a target stops at ``epochs`` times its source, and the
    excess goes to the others by weight. The level at which the shares settle is
    found from scalars only: each round sums what is capped and what is not.
    """
    spark = sizes.sparkSession
    ordered = stage(sizes.select("source", "source_size").repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_p", F.spark_partition_id()), "sources")
    counts = {r._p: r["count"] for r in ordered.groupBy("_p").count().collect()}  # one row a partition
    starts, n = [], 0
    for p in sorted(counts):
        starts.append((p, n))
        n += counts[p]
    if not n:
        return sizes.select("source", "source_size", F.lit(0.0).alias("target"))
    starts = spark.createDataFrame(starts, "_p int, _start long")
    place = F.row_number().over(Window.partitionBy("_p").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("_start")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    ranked = stage(ordered.join(F.broadcast(starts), "_p").select("source", "source_size", weight.alias("w"), (F.col("source_size") * epochs).alias("cap")), "weights")
    budget = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:  # each round caps at least one more source, or ends
        capped = F.col("cap") <= F.col("w") * level
        held, free = ranked.agg(F.sum(F.when(capped, F.col("cap")).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("w")))).first()
        new = (budget - held) / free if free else level
        if not free or new <= level:
            break
        level = new
    return ranked.select("source", "source_size", F.least("cap", F.col("w") * level).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """How often the mix takes each document.

    ``docs(doc_id, source, size)`` to doc_id, source, size, source_size, target, times
    and taken (``times * size``). A source's target is met by as many whole passes as
    fit, and by the documents whose hash of doc_id lies below a threshold for the
    rest. The threshold comes from a histogram of sizes by source and leading hash
    bits; only the bucket in which the rest runs out is looked at again, with more
    bits, until all 60 are used or no bucket is left. No sort, no sample: the
    threshold is exact, so the taken words miss the target by less than half of the
    documents that share the boundary hash. Rows with equal doc_id share a hash and
    are taken together; a null doc_id is hashed as an empty string; a null source is
    a source of its own, the last. Documents without words and sources without words
    get no share. An empty table gives an empty result.
    """
    number = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")
    rows = stage(docs.select("doc_id", "source", F.col("size").cast("long").alias("size"), number.alias("_h")), "sizes")
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, epochs)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = targets.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    # floor: hashes below it are taken; the bucket that starts there is refined
    state = stage(state.withColumn("floor", F.lit(0).cast("long")).withColumn("below", F.lit(0).cast("long")), "targets")
    for level in range(1, LEVELS + 1):
        width = 1 << (60 - BITS * level)
        parent = width << BITS
        near = rows.where("size > 0").join(state.select(F.col("source").alias("_s"), "floor"), F.col("source").eqNullSafe(F.col("_s")))
        near = near.where((F.col("_h") >= F.col("floor")) & (F.col("_h") < F.col("floor") + parent))
        bins = near.groupBy("_s", F.expr(f"_h - _h % {width}").alias("bin")).agg(F.sum("size").alias("bin_size"))
        running = Window.partitionBy("_s").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        sums = bins.withColumn("upto", F.sum("bin_size").over(running))  # at most 2**BITS rows a source
        tests = sums.join(state.withColumnRenamed("source", "source_"), F.col("_s").eqNullSafe(F.col("source_")))
        fits = F.col("below") + F.col("upto") <= F.col("rest")
        found = tests.groupBy("_s").agg(
            F.min(F.when(~fits, F.col("bin"))).alias("edge"),
            F.coalesce(F.max(F.when(fits, F.col("upto"))), F.lit(0)).alias("more"),
            F.max_by("bin_size", F.when(~fits, -F.col("bin"))).alias("edge_size"),
        )
        last = level == LEVELS
        joined = state.join(found, F.col("source").eqNullSafe(F.col("_s")), "left")
        edge = F.coalesce("edge", F.col("floor") + parent)
        under = F.col("rest") - F.col("below") - F.coalesce("more", F.lit(0))
        if last:  # the documents of the boundary hash go where the target is nearer
            edge = F.when(F.col("edge").isNotNull() & (F.col("edge_size") - under < under), F.col("edge") + 1).otherwise(edge)
        state = joined.select("source", "source_size", "target", "passes", "rest", edge.alias("floor"), (F.col("below") + F.coalesce("more", F.lit(0))).alias("below"))
        state = stage(state, f"level{level}")
    limits = state.select(F.col("source").alias("_s"), "source_size", "target", "passes", "floor")
    times = F.col("passes") + F.when(F.col("_h") < F.col("floor"), 1).otherwise(0)
    times = F.when(F.col("size") > 0, times).otherwise(F.col("passes"))
    return rows.join(limits, F.col("source").eqNullSafe(F.col("_s"))).select("doc_id", "source", "size", "source_size", "target", times.alias("times"), (times * F.col("size")).alias("taken"))
