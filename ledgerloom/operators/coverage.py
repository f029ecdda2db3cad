"""Coverage of statements, cascading deletes, and the summary of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.thresholds import MODEL, Thresholds


def statement_coverage(statements: DataFrame, txns: DataFrame, anns: DataFrame, vectors: DataFrame) -> DataFrame:
    """Transactions, labels and vectors of each statement."""
    rows = txns.select("id", "statement_id").join(anns.select(F.col("transaction_id").alias("id"), F.lit(1).alias("a")).distinct(), "id", "left")
    rows = rows.join(vectors.select(F.col("transaction_id").alias("id"), F.lit(1).alias("v")).distinct(), "id", "left")
    sums = rows.groupBy("statement_id").agg(F.countDistinct("id").alias("transactions"), F.count("a").alias("annotated"), F.count("v").alias("embedded"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return statements.select(F.col("id").alias("statement_id"), "ledger_id", "statement_month").join(sums, "statement_id", "left").select("statement_id", "ledger_id", "statement_month", zero("transactions"), zero("annotated"), zero("embedded"))


def group_members(members: DataFrame, txns: DataFrame) -> DataFrame:
    """Members with their transactions, and how many their group has."""
    fields = txns.select(F.col("id").alias("transaction_id"), "txn_date", "amount", "debit_credit", "raw_description")
    n = F.count("*").over(Window.partitionBy("group_id"))
    return members.join(fields, "transaction_id").withColumn("members", n).withColumn("place", F.row_number().over(Window.partitionBy("group_id").orderBy("txn_date", "transaction_id")))


def _cascade(gone: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What is left of annotations, vectors, links and members when ``gone`` (id) go."""
    drop = lambda df, c: df.join(gone.select(F.col("id").alias(c)), c, "left_anti").select(*df.columns)
    return {
        "annotations": drop(tables["annotations"], "transaction_id"), "vectors": drop(tables["vectors"], "transaction_id"),
        "links": drop(drop(tables["links"], "txn_a"), "txn_b"), "members": drop(tables["members"], "transaction_id"),
    }


def delete_statements(ids: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables without the statements in ``ids`` (id) and whatever hangs on them."""
    gone = tables["transactions"].join(ids.select(F.col("id").alias("statement_id")), "statement_id", "left_semi")
    out = _cascade(gone, tables)
    out["transactions"] = tables["transactions"].join(ids.select(F.col("id").alias("statement_id")), "statement_id", "left_anti").select(*tables["transactions"].columns)
    out["statements"] = tables["statements"].join(ids.select("id"), "id", "left_anti").select(*tables["statements"].columns)
    return out


def reset_statements(ids: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The same, but transactions and statements stay."""
    gone = tables["transactions"].join(ids.select(F.col("id").alias("statement_id")), "statement_id", "left_semi")
    return _cascade(gone, tables) | {"transactions": tables["transactions"], "statements": tables["statements"]}


def stage_funnel(rows: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    """Labels by stage, how many were accepted and how many go to review; a null source is the total."""
    low = F.coalesce("confidence", F.lit(0.0)) < th.confidence
    made = rows.where(F.col("source").isin(*MODEL))
    out = made.groupingSets([["ledger_id", "source"], ["ledger_id"]], "ledger_id", "source").agg(F.count("*").alias("count"), F.count(F.when(~low, 1)).alias("auto_accepted"), F.count(F.when(low, 1)).alias("review"))
    return out.withColumn("review_rate", F.round((F.col("review") / F.col("count")).cast("decimal(28,8)"), 4).cast("double"))


def score_histogram(rows: DataFrame, bins: int = 20) -> DataFrame:
    """Counts of confidence and best similarity in equal bins, empty bins included."""
    made = rows.where(F.col("source").isin(*MODEL))
    values = made.select("ledger_id", F.explode(F.array(F.struct(F.lit("confidence").alias("kind"), F.coalesce("confidence", F.lit(0.0)).alias("v")), F.struct(F.lit("similarity").alias("kind"), F.col("best_similarity").alias("v")))).alias("x"))
    binned = values.where("x.v is not null").select("ledger_id", "x.kind", F.least(F.greatest(F.floor(F.col("x.v") * bins), F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin"))
    counts = binned.groupBy("ledger_id", "kind", "bin").agg(F.count("*").alias("count"))
    grid = rows.select("ledger_id").distinct().select("ledger_id", F.explode(F.array(F.lit("confidence"), F.lit("similarity"))).alias("kind")).select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(counts, ["ledger_id", "kind", "bin"], "left").select("ledger_id", "kind", "bin", F.coalesce("count", F.lit(0)).alias("count"))


def near_misses(rows: DataFrame, band: float = 0.05, top: int = 15, th: Thresholds = Thresholds()) -> DataFrame:
    """Labels just below a gate, the nearest ones of each ledger; a row's own recorded gate counts if it has one."""
    made = rows.where(F.col("source").isin(*MODEL))
    gate = F.coalesce(F.col("own_direct"), F.lit(th.rag_direct)) if "own_direct" in rows.columns else F.lit(th.rag_direct)
    kinds = F.array(
        F.struct(F.lit("confidence").alias("kind"), F.coalesce("confidence", F.lit(0.0)).alias("value"), F.lit(th.confidence).alias("gate")),
        F.struct(F.lit("similarity").alias("kind"), F.col("best_similarity").alias("value"), gate.alias("gate")),
    )
    flat = made.select("ledger_id", "id", "category", "source", F.explode(kinds).alias("x")).select("ledger_id", "id", "category", "source", "x.*")
    near = flat.where((F.col("value") < F.col("gate")) & (F.col("value") >= F.col("gate") - band))
    place = Window.partitionBy("ledger_id", "kind").orderBy(F.col("value").desc(), "id")
    return near.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top).select("ledger_id", "kind", "rank", "id", "category", "source", F.round("value", 4).alias("value"))
