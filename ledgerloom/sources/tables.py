"""Reading and writing the ledger's tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S

STATEMENT_ROWS = "doc_id string, ledger_id long, table_no int, row_no long, cells array<string>"
GOLDEN = "transaction_id string, ledger_id long, txn_date date, category string, subcategory string, merchant string, original_source string"


def read_statement_rows(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Rows of extracted statement tables, under a fixed schema; missing cells are null."""
    return spark.read.schema(STATEMENT_ROWS).format(fmt).load(path)


def dedup_statement_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """New files by content: ``files(path, content)``, ``known(file_sha256)``; of equal ones the first path stays."""
    hashed = files.withColumn("file_sha256", F.sha2("content", 256)).drop("content")
    place = Window.partitionBy("file_sha256").orderBy("path")
    first = hashed.withColumn("_n", F.row_number().over(place)).where("_n = 1").drop("_n")
    return first.join(known.select("file_sha256").distinct(), "file_sha256", "left_anti")


def append_ledger(existing: DataFrame, new: DataFrame, path: str | None = None) -> DataFrame:
    """New transactions that are not there yet, with their counterparty key; appended by month below ``path`` if given.

    Of new rows with one id the earliest by date stays, of equal dates the one of the smallest hash.
    """
    fresh = new.join(existing.select("id"), "id", "left_anti")
    place = Window.partitionBy("id").orderBy("txn_date", F.xxhash64(*new.columns))
    fresh = fresh.withColumn("_n", F.row_number().over(place)).where("_n = 1").drop("_n")
    out = fresh.withColumn("counterparty_key", S.counterparty_key(F.col("raw_description"))).withColumn("month", S.month_of(F.col("txn_date")))
    if path:
        out.repartition("month").write.partitionBy("month").mode("append").parquet(path)
    return out


def latest_wins(existing: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: the latest by ``order``, of equal ones the new."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    place = Window.partitionBy(key).orderBy(F.col(order).desc_nulls_last(), F.col("_new").desc())
    return both.withColumn("_n", F.row_number().over(place)).where("_n = 1").drop("_n", "_new")


def upsert_annotations(existing: DataFrame, new: DataFrame) -> DataFrame:
    """One annotation a transaction; a new one replaces the old."""
    return latest_wins(existing, new, "transaction_id", "annotated_at")


def upsert_embeddings(existing: DataFrame, new: DataFrame) -> DataFrame:
    """One vector a transaction, with the model and time of the last."""
    return latest_wins(existing, new, "transaction_id", "created_at")


def golden(rows: DataFrame) -> DataFrame:
    """Labels that people set, with the source they replaced."""
    return rows.where("source = 'manual'").select(F.col("id").alias("transaction_id"), "ledger_id", "txn_date", "category", "subcategory", "merchant", "original_source")


def export_golden(rows: DataFrame, path: str) -> None:
    golden(rows).orderBy("txn_date", "transaction_id").write.mode("overwrite").json(path)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GOLDEN).json(path)


def write_eval_run(records: DataFrame, metrics: DataFrame, path: str) -> None:
    """Summary, records and failures of an evaluation as JSON lines."""
    metrics.write.mode("overwrite").json(f"{path}/summary")
    records.write.mode("overwrite").json(f"{path}/records")
    records.where(~F.col("correct")).write.mode("overwrite").json(f"{path}/failures")


def embed_pending(rows: DataFrame, vectors: DataFrame, model: str, embed: Callable[[list[str]], list[list[float]]], batch: int = 32, redo: bool = False) -> DataFrame:
    """Vectors of labelled rows that this model has not seen, made by ``embed`` in batches.

    Rows of a batch that fails have no embedding but the failure's text in ``error``, so
    that they can be counted; they stay pending. Returns transaction_id, model_version,
    embedding, error.
    """
    todo = rows.where("annotation_id is not null")
    if not redo:
        todo = todo.join(vectors.where(F.col("model_version") == model).select(F.col("transaction_id").alias("id")), "id", "left_anti")
    texts = todo.select("id", S.embed_text(F.col("debit_credit"), F.col("raw_description"), F.col("note")).alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                try:
                    made, error = embed(part["text"].tolist()), None
                except Exception as e:  # noqa: BLE001  the service's failure, not ours
                    made, error = [None] * len(part), f"{type(e).__name__}: {e}"
                yield pd.DataFrame({"transaction_id": part["id"], "model_version": model, "embedding": made, "error": error})

    return texts.mapInPandas(run, "transaction_id string, model_version string, embedding array<float>, error string")


def failed_embeddings(made: DataFrame) -> DataFrame:
    """How many rows failed, by the failure's text."""
    return made.where("error is not null").groupBy("error").agg(F.count("*").alias("rows"))
