"""Incremental forms: new rows through the deterministic stages, feedback counts, daily cash."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.operators.cascade import first_of
from ledgerloom.operators.rules import RULE_CONFIDENCE, default_rules, match_keyword_rules, match_people
from ledgerloom.thresholds import MODEL, Thresholds


def run_once(query) -> None:
    """Let a stream take all that is there, then end."""
    q: StreamingQuery = query.trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def stream_annotate(stream: DataFrame, out: str, checkpoint: str, people: DataFrame, learned: DataFrame, late: str = "30 days") -> None:
    """Label new transactions by the stages without a model as their files arrive: people, keyword rules, learned rules.

    ``stream`` has file_sha256, id, ledger_id, uploaded_at, raw_description, vpa, note,
    counterparty_key. A file that is uploaded again has the same hash, and its rows are
    dropped within the watermark; ``people`` and ``learned`` are read as they are when a
    batch runs. Writes id, the label, stage and batch.
    """
    fresh = stream.withWatermark("uploaded_at", late).dropDuplicatesWithinWatermark(["file_sha256", "id"])
    none = F.lit(None).cast("string").alias("subcategory")

    # what doesn't change from batch to batch is computed once
    known = learned.select("ledger_id", "counterparty_key", "category").persist()
    tables = [df.persist() for df in default_rules(stream.sparkSession)]

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # three stages read it, and its state must not be asked twice
        try:
            label = lambda df, category, subcategory, confidence, source: df.select("id", category.alias("category"), subcategory.alias("subcategory"), confidence.alias("confidence"), F.lit(source).alias("source"))
            person = label(match_people(batch, people), F.lit("Transfers"), F.col("subcategory"), F.lit(RULE_CONFIDENCE), "rule")
            keyword = label(match_keyword_rules(batch, *tables).where("label is not null"), F.col("label.category"), F.col("label.subcategory"), F.col("label.confidence"), "rule")
            rules = batch.select("id", "ledger_id", "counterparty_key").join(known, ["ledger_id", "counterparty_key"])
            found = first_of([("person", person), ("keyword", keyword), ("learned", label(rules, F.col("category"), none, F.lit(Thresholds().learned_confidence), "learned_rule"))])
            found.write.mode("overwrite").parquet(f"{out}/batch={number}")  # a batch that runs again replaces itself
        finally:
            batch.unpersist()

    try:
        run_once(fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint))
    finally:
        for df in (known, *tables):
            df.unpersist()


def stream_feedback(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Counts of review decisions by source and category, kept up to date."""
    n = lambda k: F.count(F.when(F.col("feedback") == k, 1)).alias(k)
    counts = stream.where(F.col("source").isin(*MODEL)).groupBy("source", "category").agg(n("confirmed"), n("refined"), n("corrected"))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    run_once(counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint))


def latest(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """The last state of each key that an update stream wrote."""
    rows = spark.read.option("basePath", out).parquet(out)
    fields = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*fields), "batch").alias("_s")).select(*keys, "_s.*")


CASH = "ledger_id long, day date, debit_credit string, amount decimal(28,2), n long, batch int"
ROWS = "ledger_id long, at timestamp, debit_credit string, amount decimal(18,2), batch int"


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What batches have written below ``path`` so far, none if nothing has."""
    try:
        return spark.read.schema(schema).option("basePath", path).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def stream_monthly_cash(stream: DataFrame, out: str, checkpoint: str, late_days: int = 400) -> None:
    """Sums per ledger, day (UTC) and direction, kept by the engine, and a side table of rows behind its watermark.

    ``stream`` has ledger_id, at, debit_credit, amount. Days are tumbling windows over
    ``at``; a day's sum is the engine's state and is written anew (update mode) below
    ``out/days`` whenever rows of it come. The engine drops rows of days that end before its
    watermark, the latest time of earlier batches less ``late_days``, and forgets such
    days. A batch also holds its rows as they came, and those whose day it did not tell
    anew are what the engine dropped: they go to ``out/late``, for a batch job. A batch
    that runs again replaces what it wrote; a restart goes on from the checkpoint. Rows
    without a time have no day and go to no table.
    """
    keys = ["ledger_id", "day", "debit_credit"]
    rows = stream.where("at is not null").select("ledger_id", "at", "debit_credit", F.col("amount").cast("decimal(18,2)").alias("amount")).withWatermark("at", f"{late_days} days")
    day = F.to_date(F.timestamp_seconds(F.col("w.end").cast("long") - 86400)).alias("day")
    days = rows.groupBy("ledger_id", F.window("at", "1 day").alias("w"), "debit_credit").agg(F.sum("amount").alias("total"), F.count("*").alias("n"))
    days = days.select("ledger_id", day, "debit_credit", "total", "n", F.lit(None).cast("timestamp").alias("at"), F.lit(None).cast("decimal(18,2)").alias("amount"))
    raw = rows.select("ledger_id", F.window("at", "1 day").alias("w"), "debit_credit", "at", "amount").select("ledger_id", day, "debit_credit", F.lit(None).cast("decimal(28,2)").alias("total"), F.lit(None).cast("long").alias("n"), "at", "amount")

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            told, came = batch.where("n is not null"), batch.where("n is null")
            known = told.select(*[F.col(c).alias(f"_{c}") for c in keys])
            same = F.lit(True)
            for c in keys:
                same = same & came[c].eqNullSafe(known[f"_{c}"])
            late = came.join(known, same, "left_anti").select("ledger_id", "at", "debit_credit", "amount")
            late.write.mode("overwrite").parquet(f"{out}/late/batch={number}")
            told.select(*keys, F.col("total").cast("decimal(28,2)").alias("amount"), "n").write.mode("overwrite").parquet(f"{out}/days/batch={number}")
        finally:
            batch.unpersist()

    run_once(days.unionByName(raw).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint))


def late_rows(spark: SparkSession, out: str) -> DataFrame:
    """The side table: rows that came behind the watermark."""
    return _stored(spark, f"{out}/late", ROWS)


def daily_cash(spark: SparkSession, out: str) -> DataFrame:
    """The days as they are after the late rows have been summed in too."""
    late = late_rows(spark, out).groupBy("ledger_id", F.to_date("at").alias("day"), "debit_credit").agg(F.sum("amount").alias("amount"), F.count("*").alias("n"))
    keys = ["ledger_id", "day", "debit_credit"]
    days = _stored(spark, f"{out}/days", CASH).groupBy(*keys).agg(F.max_by(F.struct("amount", "n"), "batch").alias("_s")).select(*keys, "_s.*")
    both = days.unionByName(late)
    return both.groupBy("ledger_id", "day", "debit_credit").agg(F.sum("amount").alias("amount"), F.sum("n").alias("n"))


def monthly(daily: DataFrame) -> DataFrame:
    """Months of the daily sums."""
    total = lambda d: F.sum(F.when(F.col("debit_credit") == d, F.col("amount")).otherwise(0)).cast("double")
    return daily.groupBy("ledger_id", F.date_format("day", "yyyy-MM").alias("month")).agg(F.round(total("credit"), 2).alias("money_in"), F.round(total("debit"), 2).alias("money_out"), F.sum("n").alias("rows"))
