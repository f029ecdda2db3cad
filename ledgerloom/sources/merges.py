"""Batches merged into partitioned tables, of which only the touched partitions are read and written."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.sources.tables import latest_wins

#: Parts into which a table by ledger is cut.
BUCKETS = 64


def bucket(ledger: str = "ledger_id", buckets: int = BUCKETS) -> Column:
    """The part of a table in which a ledger lies."""
    return F.pmod(F.xxhash64(ledger), F.lit(buckets)).cast("int").alias("bucket")


def touched(new: DataFrame, by: list[str]) -> list[Row]:
    """The partitions that a batch touches; as many rows as there are partitions, at most."""
    return new.select(*by).distinct().collect()


def stored(spark: SparkSession, path: str, like: DataFrame, by: list[str], parts: list[Row]) -> DataFrame:
    """The rows of some partitions of a table, none if there is no table yet; other partitions are never listed in the scan."""
    try:
        table = spark.read.schema(like.schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return like.limit(0)
    if not parts:
        return table.limit(0)
    last = by[-1]
    groups: dict[tuple, list] = {}
    for p in parts:
        groups.setdefault(tuple(p[c] for c in by[:-1]), []).append(p[last])
    one = lambda head, tails: reduce(lambda a, b: a & b, [F.col(c) == v for c, v in zip(by, head, strict=False)], F.col(last).isin(*tails))
    return table.where(reduce(lambda a, b: a | b, [one(h, t) for h, t in groups.items()]))


def merge_into(path: str, new: DataFrame, by: list[str], merge: Callable[[DataFrame, DataFrame], DataFrame], keep: Callable[[DataFrame], DataFrame]) -> None:
    """Replace the partitions of ``new`` by ``merge(their rows, new)``.

    ``keep`` stores the merged rows elsewhere, as a partition can't be read and replaced by one
    job; a job that fails before the last write has changed nothing, and one that runs
    again writes the same. Partitions that the batch doesn't touch keep their files. Null
    partition values are not allowed.
    """
    spark = new.sparkSession
    old = stored(spark, path, new, by, touched(new, by))
    merged = keep(merge(old, new).select(*new.columns))
    # rows of a partition come together, and large partitions are split again
    merged.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def absent_wins(key: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Old rows as they are, and the new ones whose ``key`` is not there, one each."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        place = Window.partitionBy(key).orderBy(F.xxhash64(*new.columns))
        fresh = new.join(old.select(key), key, "left_anti").withColumn("_n", F.row_number().over(place)).where("_n = 1").drop("_n")
        return old.unionByName(fresh)

    return merge


def append_statements(root: str, statements: DataFrame, transactions: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> None:
    """Statements and their transactions into ``root``/statements and ``root``/transactions, those that are there already left alone.

    Both are cut by month: a statement's is statement_month, a transaction's that of
    its date, with its counterparty key derived here. A statement or transaction is looked
    for in the months of the batch alone, as its id keeps its month; one that is
    uploaded again therefore changes nothing. Statements come first, so a failure in between leaves
    none of the transactions without theirs.
    """
    merge_into(f"{root}/statements", statements, ["statement_month"], absent_wins("id"), keep)
    keyed = transactions.withColumn("counterparty_key", S.counterparty_key(F.col("raw_description"))).withColumn("month", S.month_of(F.col("txn_date")))
    merge_into(f"{root}/transactions", keyed, ["month"], absent_wins("id"), keep)


def upsert_labels(path: str, new: DataFrame, keep: Callable[[DataFrame], DataFrame], key: str = "transaction_id", order: str = "annotated_at", buckets: int = BUCKETS) -> None:
    """Latest labels (or vectors, by created_at) into a table cut by ledger: only the parts of the batch's ledgers are read and written."""
    merge_into(path, new.withColumn("bucket", bucket(buckets=buckets)), ["bucket"], lambda old, new: latest_wins(old, new, key, order), keep)
