"""Pieces that several corpus operators share."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """A new folder's path below the cluster's shared folder.

    The shared folder is ``spark.checkpoint.dir``. Only in local mode, as in tests, may
    it be unset: a folder of this machine takes its place. On a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file:///tmp/checkpoints/local-{os.getpid()}"
    return f"{root.rstrip('/')}/ledgerloom-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage so that a lost executor costs a re-read, not a recomputation,
    and gives the optimizer real sizes for what follows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_batches(
    df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType
) -> DataFrame:
    """``mapInArrow`` under a name that says what the operators use it for."""
    return df.mapInArrow(fn, schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that fewer texts are held at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a string column as UTF-8; a null text is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def same_row(docs: DataFrame, keys: DataFrame):
    """Whether a row of ``docs`` has the doc_id and the text of ``keys(doc_id, text_hash)``; null is a value here."""
    return docs["doc_id"].eqNullSafe(keys["doc_id"]) & (F.xxhash64(docs["text"]) == keys["text_hash"])


def first_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows that agree in ``keys`` the first by all other columns in the order of their names; columns that have no order (maps) don't count."""
    others = sorted(c for c in rows.columns if c not in keys)
    ordered = [c for c in others if "map<" not in rows.schema[c].dataType.simpleString() and "variant" not in rows.schema[c].dataType.simpleString()]
    if not others:
        return rows.dropDuplicates(keys)
    row = F.min_by(F.struct(*others), F.struct(*ordered) if ordered else F.lit(0))
    return rows.groupBy(*keys).agg(row.alias("_row")).select(*keys, "_row.*").select(*rows.columns)


def ascii_lower(col):
    """Lower-case A-Z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph: ``edges(a, b)`` to ``(node, root)``.

    Alternates the large-star and small-star steps until no edge changes, which takes a
    number of rounds that grows with the logarithm of the nodes; ``root`` is the smallest node of a component. Self-loops and repeated edges are
    harmless, an empty edge table gives an empty result. Nodes without edges are
    not in the result. Every round is written to the shared folder; only counts
    reach the driver.
    """
    pairs = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    if pairs.isEmpty():
        return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        # large star: every larger neighbour moves to the smallest neighbour
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, "large")
        # small star: every node and its smaller neighbours move to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
            .select("e.u", F.col("e.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        small = stage(small, "small")
        moved = small.join(pairs, ["u", "v"], "left_anti").isEmpty() and pairs.join(small, ["u", "v"], "left_anti").isEmpty()
        pairs = small
        if moved:
            found = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return found.union(found.select("root", "root").distinct())
