"""Shards of near-equal bytes by Karmarkar-Karp differencing (operator 3)."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: Groups that one task differences; tasks grow with the groups, each leaves one row of sums.
GROUPS_A_TASK = 1 << 16
BLOCK = 4096
#: Tasks' sums that are differenced at once.
FAN = 1024


class Partial:
    """A partial partition: ascending sums of ``k`` parts, and where they came from."""

    __slots__ = ("sums", "left", "right", "order", "leaf")

    def __init__(self, sums, left=None, right=None, order=None, leaf=-1):
        self.sums, self.left, self.right, self.order, self.leaf = sums, left, right, order, leaf


def difference(partials: list[Partial]) -> Partial:
    """Join the two partitions of largest spread, oppositely ordered, until one is left."""
    heap = [(-int(p.sums[-1] - p.sums[0]), i, p) for i, p in enumerate(partials)]
    heapq.heapify(heap)
    at = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        sums = a.sums + b.sums[::-1]
        order = np.argsort(sums, kind="stable")
        sums = sums[order]
        heapq.heappush(heap, (-int(sums[-1] - sums[0]), at, Partial(sums, a, b, order)))
        at += 1
    return heap[0][2]


def places(root: Partial, k: int, n: int) -> np.ndarray:
    """For each leaf, the root's part for each of its own parts: an (n, k) table."""
    out = np.empty((n, k), np.int16)
    todo = [(root, np.arange(k, dtype=np.int16))]
    while todo:
        node, to = todo.pop()
        if node.left is None:
            out[node.leaf] = to
            continue
        own = np.empty(k, np.int16)
        own[node.order] = to  # the part at sorted place p came from order[p]
        todo.append((node.left, own))
        todo.append((node.right, own[::-1]))
    return out


def assign(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Parts of ``sizes`` and the parts' sums, differenced in blocks of similar sizes."""
    order = np.argsort(-sizes, kind="stable")
    parts, tops = np.empty(len(sizes), np.int16), []
    spans = [order[a : a + BLOCK] for a in range(0, len(sizes), BLOCK)]
    for j, span in enumerate(spans):
        leaves = []
        for i, s in enumerate(sizes[span]):
            own = np.zeros(k, np.int64)
            own[-1] = s
            leaves.append(Partial(own, leaf=i))
        top = difference(leaves)
        parts[span] = places(top, k, len(span))[:, -1]
        tops.append(Partial(top.sums, leaf=j))
    root = difference(tops)
    to = places(root, k, len(spans))
    for j, span in enumerate(spans):
        parts[span] = to[j][parts[span]]
    return parts, root.sums


def turn(sums: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Difference partitions of ``k`` sums each: the joint part of each one's parts, and the joint sums."""
    root = difference([Partial(np.sort(s), leaf=i) for i, s in enumerate(sums)])
    at, to = places(root, k, len(sums)), np.empty((len(sums), k), np.int32)
    for i, s in enumerate(sums):
        to[i][np.argsort(s, kind="stable")] = at[i]
    return to, root.sums


def joined(nodes: DataFrame, k: int, n: int) -> DataFrame:
    """``nodes(node, sums)``, numbered below ``n``, to node and ``to``, the part of the whole for each of a node's parts.

    ``FAN`` nodes are differenced by one task and leave one node of the next level, until a
    level has ``FAN`` nodes at most; these alone come to the driver. Their parts are then handed
    down level by level.
    """
    spark, levels = nodes.sparkSession, []

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node", ignore_index=True)
        to, sums = turn([np.array(s, np.int64) for s in frame["sums"]], k)
        return pd.DataFrame({"node": frame["node"], "parent": frame["parent"], "to": list(to), "sums": [sums] * len(frame)})

    while n > FAN:
        grouped = nodes.withColumn("parent", F.floor(F.col("node") / FAN)).groupBy("parent")
        levels.append(stage(grouped.applyInPandas(one, "node long, parent long, to array<int>, sums array<long>"), "level"))
        nodes = levels[-1].groupBy(F.col("parent").alias("node")).agg(F.first("sums").alias("sums"))
        n = -(-n // FAN)
    top = nodes.orderBy("node").collect()
    to = turn([np.array(r.sums, np.int64) for r in top], k)[0] if top else []
    out = spark.createDataFrame([(r.node, t.tolist()) for r, t in zip(top, to, strict=True)], "node long, to array<int>")
    for level in reversed(levels):
        above = out.select(F.col("node").alias("parent"), F.col("to").alias("_to"))
        out = level.join(above, "parent").select("node", F.transform("to", lambda x: F.get("_to", x)).alias("to"))
    return out


def shard_by_bytes(docs: DataFrame, shards: int = 40, row_bytes: int = 16) -> DataFrame:
    """Deal ``docs(doc_id, text)`` into shards of near-equal bytes, equal texts together.

    Groups of equal texts (null and empty texts are equal) are reduced to (hash,
    bytes) before any shuffle. Each task differences its groups and leaves one row of
    ``shards`` sums; these rows are differenced in a tree (:func:`joined`), of which only
    the last level is done by the driver. A group cannot be
    split, so one that exceeds a shard's fair share makes its shard that large.
    ``slot`` numbers a shard's rows from 0: rows are counted by (input partition,
    shard), and only these counts are summed up in one place. Rows that repeat and
    null ids each keep a slot of their own. An empty table gives an empty result.
    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + row_bytes).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_g"),
        F.spark_partition_id().alias("_p"),
    )
    rows = stage(rows, "rows")
    groups = rows.groupBy("_g").agg(F.sum("size").alias("size"))
    tasks = max(1, -(-groups.count() // GROUPS_A_TASK))
    groups = groups.withColumn("_t", F.pmod(F.xxhash64("_g"), F.lit(tasks)).cast("int"))

    def local(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["size", "_g"], ascending=[False, True], ignore_index=True)
        parts, sums = assign(frame["size"].to_numpy(np.int64), shards)
        return pd.DataFrame({"_t": frame["_t"], "_g": frame["_g"], "part": parts.astype("int32"), "sum": sums[parts]})

    dealt = stage(groups.groupBy("_t").applyInPandas(local, "_t int, _g long, part int, sum long"), "parts")
    sums = dealt.groupBy(F.col("_t").cast("long").alias("node"), "part").agg(F.first("sum").alias("sum"))
    sums = sums.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("part", "sum"))).alias("m"))
    every = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long")))
    turned = joined(sums.select("node", every.alias("sums")), shards, tasks)
    shard_of = dealt.join(turned, F.col("_t") == F.col("node")).select("_g", F.get("to", F.col("part")).alias("shard"))
    shard_of = stage(shard_of, "shards")
    placed = stage(rows.join(shard_of, "_g").select("doc_id", "size", "text_crc32", "_p", "shard"), "placed")
    return number_slots(placed, ["doc_id", "size", "text_crc32"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def number_slots(placed: DataFrame, order: list[str]) -> DataFrame:
    """Gapless slots from 0 within each shard, in the order of input partitions.

    The window holds the rows of one input partition and one shard; what is summed
    over a whole shard is one count for each input partition.
    """
    counts = placed.groupBy("shard", "_p").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy("_p", "shard").orderBy(*order)
    return placed.withColumn("_i", F.row_number().over(own) - 1).join(starts, ["shard", "_p"]).withColumn("slot", (F.col("_start") + F.col("_i")).cast("long"))

