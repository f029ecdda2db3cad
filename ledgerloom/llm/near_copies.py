"""SimHash near-dedup at a Jaccard similarity (operator 7 as the pipeline uses it).

Fingerprints over wider shingles are linked through their Golay keys as in
:mod:`simhash`, and each link is verified by the exact similarity. At a similarity of
0.8, fingerprints of 64 bits differ in some ten bits, far beyond what keys over their
segments can find, so MinHash bands give the candidates that the keys miss; these are
verified in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, map_batches, slices, stage, utf8
from .simhash import digests, folded
from .simhash import links as golay_links

SHINGLE, SIMILARITY = 5, 0.8
#: Bands of MinHash values. A pair of similarity s shares no band with probability (1 - s^ROWS)^BANDS: 2e-6 at 0.8.
BANDS, ROWS = 25, 4

_DRAW = np.random.default_rng(42)
_TIMES = _DRAW.integers(0, 1 << 63, BANDS * ROWS, np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
_PLUS = _DRAW.integers(0, 1 << 63, BANDS * ROWS, np.uint64)[:, None]
_MIX = _DRAW.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of a text's different word shingles; a text of fewer words is one shingle."""
    return _different(list(digests(text.lower().split(), shingle)))


def _different(pieces: list[bytes]) -> np.ndarray:
    return np.unique(np.frombuffer(b"".join(pieces), np.uint64))


def bands(found: np.ndarray) -> np.ndarray:
    """One key for each band of the MinHash of some shingles; the band's number is part of it."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 1 << 11):
        np.minimum(low, (found[None, at : at + (1 << 11)] * _TIMES + _PLUS).min(axis=1), out=low)
    keys = low.reshape(BANDS, ROWS)
    keys = ((keys ^ (keys >> np.uint64(29))) * _MIX).sum(axis=1, dtype=np.uint64)
    return (keys ^ (keys >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + np.arange(BANDS, dtype=np.uint64)


def sketches(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``docs(doc_id, text)`` to doc_id, text_hash, node (a hash of the text's words), n (its different shingles), fp (its fingerprint) and bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            node, n, fp, keys = [], [], [], []
            for text in utf8(batch.column("text")):
                words = text.lower().split()
                pieces = list(digests(words, shingle))
                found = _different(pieces)
                node.append(xxhash.xxh64_intdigest(b" ".join(words), 7))
                n.append(len(found))
                fp.append(folded(pieces))
                keys.append(bands(found).view(np.int64) if len(found) else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, keys)], dtype=np.int32), np.concatenate(keys or [np.zeros(0, np.int64)]))
            cols = [batch.column("doc_id"), batch.column("text_hash"), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(n, pa.int64()), pa.array(np.array(fp, np.uint64).view(np.int64)), lists]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text_hash", "node", "n", "fp", "bands"])

    schema = "doc_id long, text_hash long, node long, n long, fp long, bands array<long>"
    return map_batches(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), run, schema)


def shingle_sets(texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``texts(node, text)`` to node and found, the hashes of its different shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shingles(t, shingle).view(np.int64) for t in utf8(batch.column("text"))]
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, found)], dtype=np.int32), np.concatenate(found or [np.zeros(0, np.int64)]))
            yield pa.RecordBatch.from_arrays([batch.column("node"), lists], names=["node", "found"])

    return map_batches(texts.select("node", "text"), run, "node long, found array<long>")


def fingerprint_pairs(points: DataFrame) -> DataFrame:
    """``points(node, n, fp)`` to the pairs of nodes that fingerprints within two bits tie together: a, b, na, nb."""
    points = stage(points, "fingerprints")
    heads = stage(points.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("h")), "heads")
    same = points.join(heads, "fp").where("node > h.node").select(F.col("h.node").alias("a"), F.col("node").alias("b"), F.col("h.n").alias("na"), F.col("n").alias("nb"))
    side = lambda x: heads.select(F.col("fp").alias(x), F.col("h").alias(f"h{x}"))
    near = golay_links(heads.select("fp")).join(side("a"), "a").join(side("b"), "b")
    x, y = F.least("ha", "hb"), F.greatest("ha", "hb")
    return same.union(near.select(x["node"].alias("a"), y["node"].alias("b"), x["n"].alias("na"), y["n"].alias("nb")))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Those of ``pairs(a, b)`` whose exact similarity is ``similarity`` or more."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("found").alias("fa")), "a").join(sets.select(F.col("node").alias("b"), F.col("found").alias("fb")), "b")
    both = both.withColumn("common", F.size(F.array_intersect("fa", "fb")))
    return both.where(F.col("common") >= similarity * (F.size("fa") + F.size("fb") - F.col("common"))).select("a", "b")


def rare_first(sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``sets(node, found)`` to node, n, at and shingle: of each node as many of its rarest shingles as any similar node must share one of.

    Two sets of a similarity of ``similarity`` or more that are both cut to the
    first n - ceil(similarity * n) + 1 shingles in one order have one in common; ``at``
    is a shingle's place in that order, from 0. With the rarest first, passages of many texts come last and seldom belong to the cut.
    """
    each = sets.select("node", F.size("found").alias("n"), F.explode("found").alias("shingle"))
    known = each.groupBy("shingle").agg(F.count("*").alias("df"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("df", "shingle")) - 1
    take = F.col("n") - F.ceil(F.col("n") * similarity - 1e-6) + 1
    return each.join(known, "shingle").withColumn("at", place).where(F.col("at") < take).select("node", "n", "at", "shingle")


def across(placed: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``placed(node, n, root, at, shingle)`` to pairs (a, b) of nodes with a shingle in common and different roots.

    The members of a shingle's largest component meet only those of its others, never each
    other. What stands before the first common shingle of two nodes is not common, so
    pairs that can't be similar enough with what is left are not made.
    """
    groups = placed.groupBy("shingle", "root").count()
    most = groups.groupBy("shingle").agg(F.max_by("root", F.struct("count", "root")).alias("most"), F.count("*").alias("roots")).where("roots > 1")
    mixed = stage(placed.join(most.select("shingle", "most"), "shingle"), "mixed")
    a = mixed.where("root <> most").select("shingle", F.col("node").alias("a"), (F.col("n") - F.col("at")).alias("la"), F.col("n").alias("na"), F.col("root").alias("ra"))
    b = mixed.select("shingle", "most", F.col("node").alias("b"), (F.col("n") - F.col("at")).alias("lb"), F.col("n").alias("nb"), F.col("root").alias("rb"))
    enough = F.least("la", "lb") * F.lit(1 + similarity) >= F.lit(similarity) * (F.col("na") + F.col("nb")) - 1e-6
    pairs = a.join(b, "shingle").where("ra <> rb and (rb = most or a < b)").where(enough)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def links(rows: DataFrame, docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Edges (a, b) that connect all nodes of :func:`sketches` that are similar enough and have a Golay key or a band in common.

    First come the nodes whose fingerprints the Golay keys link, a fingerprint's nodes
    standing behind its smallest. Then each node is held against two nodes of each of
    its bands: the smallest, and the central one, which shares most bands with most
    nodes. That ties nearly every group of near copies together. The nodes of bands
    that still hold several components are compared across components where their
    rarest shingles meet (:func:`rare_first`), which is exact, so no link is lost and
    no band or group lists its pairs.
    """
    points = rows.where("n > 0").groupBy("node").agg(F.min("n").alias("n"), F.min(F.struct("text_hash", "doc_id")).alias("source"), F.min("fp").alias("fp"), F.min("bands").alias("bands"))
    keys = stage(points.select("node", "n", F.explode("bands").alias("key")), "bands")
    sizes = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = stage(keys.join(sizes, "key"), "members")
    reach = members.groupBy("node").agg(F.sum("size").alias("reach"))
    least, central = F.min(F.struct("node", "n")), F.max_by(F.struct("node", "n"), F.struct("reach", "node"))
    heads = members.join(reach, "node").groupBy("key").agg(F.array_distinct(F.array(least, central)).alias("heads"))
    close = f"least(na, nb) >= {similarity} * greatest(na, nb)"  # no other pair can be similar enough
    stars = members.join(heads, "key").select("node", "n", F.explode("heads").alias("h")).where("node <> h.node")
    x, y = F.struct("node", "n"), F.col("h")
    stars = stars.select(F.least(x, y).alias("x"), F.greatest(x, y).alias("y"))
    stars = stars.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"))
    stars = stars.union(fingerprint_pairs(points.select("node", "n", "fp")))
    stars = stage(stars.where(close).select("a", "b").distinct(), "stars")

    ends = stars.select(F.explode(F.array("a", "b")).alias("node")).union(members.select("node")).distinct()
    wanted = points.select("node", "source").join(ends, "node", "left_semi")
    wanted = wanted.select("node", "source.*").withColumnRenamed("doc_id", "_id")
    # one row for each text, whichever: equal hashes are equal texts, and the id keeps copies of a text out
    texts = docs.select(F.col("doc_id").alias("_of"), F.xxhash64("text").alias("text_hash"), "text")
    texts = texts.join(wanted, (texts["text_hash"] == wanted["text_hash"]) & texts["_of"].eqNullSafe(wanted["_id"])).drop(texts["text_hash"])
    sets = stage(shingle_sets(texts.dropDuplicates(["node"]), shingle), "sets")

    edges = stage(verified(stars, sets, similarity), "edges")
    roots = connected_components(edges)
    placed = stage(members.select("key", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")
    mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    open_ = stage(placed.join(mixed, "key", "left_semi").select("node", "root").distinct(), "open")
    rare = stage(rare_first(sets.join(open_, "node", "left_semi"), similarity).join(open_, "node"), "rare")
    rest = stage(across(rare, similarity).join(stars, ["a", "b"], "left_anti"), "rest")
    return edges.union(verified(rest, sets, similarity))


def rooted(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Each row's doc_id, text_hash and root, the smallest node of its component of near copies."""
    rows = stage(sketches(docs, shingle), "sketches")
    roots = connected_components(links(rows, docs, shingle, similarity))
    return rows.join(roots, "node", "left").select("doc_id", "text_hash", F.coalesce("root", "node").alias("root"))


def _first():
    return F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_hash")).alias("_f")


def representatives(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One doc_id and text_hash for each component of near copies.

    Near copies are texts whose sets of word shingles (A-Z lower-cased) have a Jaccard
    similarity of ``similarity`` or more; components are closed over them. Texts of
    equal words are one node; so are all texts without words, null ones among them,
    and these are like no other. The representative is the smallest doc_id, null
    last, and of rows that share it the smallest hash of the text; components of null
    ids alone have one each. An empty table gives none.
    """
    return rooted(docs, shingle, similarity).groupBy("root").agg(_first()).select("_f.doc_id", "_f.text_hash")


def surplus(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """What :func:`representatives` leaves out: doc_id, text_hash and keep.

    One row for each doc_id and text that is no representative (keep is false) or is one
    and stands in several rows, of which one is to be kept (keep is true). All other
    rows stay as they are, so this grows with the copies, not with the corpus.
    """
    rows = rooted(docs, shingle, similarity)
    several = stage(rows.groupBy("root").agg(_first(), F.count("*").alias("_n")).where("_n > 1").select("root", "_f"), "several")
    keep = F.col("doc_id").eqNullSafe(F.col("_f.doc_id")) & (F.col("text_hash") == F.col("_f.text_hash"))
    told = rows.join(several, "root").groupBy("doc_id", "text_hash").agg(F.max(keep).alias("keep"), F.count("*").alias("_n"))
    return stage(told.where("not keep or _n > 1").select("doc_id", "text_hash", "keep"), "surplus")
