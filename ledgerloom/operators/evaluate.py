"""Evaluation without leakage: only what stood before a row may label it."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.listing import personal_cohort
from ledgerloom.thresholds import TRUSTED, Thresholds

four = lambda c: F.round(c.cast("decimal(28,8)"), 4).cast("double")


#: Metrics of a run in the order of its report; a drop of the last two beyond the tolerance is a regression.
METRICS = ("coverage", "brier", "auto_accept_rate", "review_rate", "mean_latency_s", "accuracy", "auto_accept_precision")
WATCHED = METRICS[-2:]


def eval_metrics(records: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    """Coverage, accuracy, Brier score, routing and latency per stage, and over all as the row of a null stage.

    ``records`` has run, stage, confidence, correct and, if it was measured, latency_s;
    coverage is a stage's share of its run. Records without a stage count as "none".
    """
    ok, auto = F.col("correct").cast("double"), F.col("confidence") >= th.confidence
    latency = F.col("latency_s").cast("decimal(14,6)") if "latency_s" in records.columns else F.lit(None).cast("decimal(14,6)")
    staged = records.withColumn("stage", F.coalesce("stage", F.lit("none"))).withColumn("_latency", latency)
    out = staged.groupingSets([["run", "stage"], ["run"]], "run", "stage").agg(
        F.count("*").alias("n"), four(F.avg(ok)).alias("accuracy"), four(F.avg(F.round(F.pow(F.col("confidence") - ok, F.lit(2)), 10).cast("decimal(20,10)"))).alias("brier"),
        F.count(F.when(auto, 1)).alias("auto_n"), F.count(F.when(auto & F.col("correct"), 1)).alias("auto_ok"), F.round((F.sum("_latency") / F.count("_latency")).cast("decimal(20,8)"), 3).cast("double").alias("mean_latency_s"),
    )
    whole = F.max("n").over(Window.partitionBy("run"))
    return out.select(
        "run", "stage", "n", four(F.col("n") / whole).alias("coverage"), "accuracy", "brier", four(F.col("auto_n") / F.col("n")).alias("auto_accept_rate"), F.when(F.col("auto_n") > 0, four(F.col("auto_ok") / F.col("auto_n"))).alias("auto_accept_precision"),
        four((F.col("n") - F.col("auto_n")) / F.col("n")).alias("review_rate"), "mean_latency_s",
    )


def eval_report(metrics: DataFrame, before: str, after: str, tolerance: float = 0.01) -> DataFrame:
    """Two runs' metrics side by side: stage (null: over all), metric, before, after, delta, regressed.

    A metric regressed if it is watched (accuracy, precision of what is accepted
    unseen) and fell by more than ``tolerance``; a precision that a run does not have is 0
    there. A stage that one run lacks has nulls on its side.
    """
    long = metrics.unpivot(["run", "stage"], list(METRICS), "metric", "value")
    side = lambda run, name: long.where(F.col("run") == run).select("stage", "metric", F.col("value").alias(name), F.lit(True).alias(f"_{name}"))
    a, b = side(before, "before").alias("a"), side(after, "after").alias("b")
    both = a.join(b, F.col("a.stage").eqNullSafe(F.col("b.stage")) & (F.col("a.metric") == F.col("b.metric")), "full")
    exact = lambda c: F.coalesce(F.col(c), F.lit(0.0)).cast("decimal(20,6)")
    fell = F.col("_before").isNotNull() & F.col("_after").isNotNull() & (exact("before") - exact("after") > F.lit(Decimal(str(tolerance))))
    metric = F.coalesce("a.metric", "b.metric")
    delta = F.round(F.col("after").cast("decimal(20,6)") - F.col("before").cast("decimal(20,6)"), 4).cast("double")
    return both.select(F.coalesce("a.stage", "b.stage").alias("stage"), metric.alias("metric"), "before", "after", delta.alias("delta"), F.coalesce(fell & metric.isin(*WATCHED), F.lit(False)).alias("regressed"))


def regression(report: DataFrame) -> DataFrame:
    """Whether a run regressed over all, and by which metrics, as one row."""
    over_all = report.where("stage IS NULL AND regressed")
    return over_all.agg((F.count("*") > 0).alias("regressed"), F.array_sort(F.collect_list("metric")).alias("metrics"))


def eval_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of two runs whose label, stage or outcome changed, and how; ``eval_report`` compares their metrics."""
    side = lambda df, p: df.select("transaction_id", *[F.col(c).alias(f"{p}_{c}") for c in ("category", "stage", "correct")])
    both = side(a, "a").join(side(b, "b"), "transaction_id")
    changed = ~(F.col("a_category").eqNullSafe(F.col("b_category")) & F.col("a_stage").eqNullSafe(F.col("b_stage")) & F.col("a_correct").eqNullSafe(F.col("b_correct")))
    outcome = F.when(F.col("a_correct") & ~F.col("b_correct"), "regressed").when(~F.col("a_correct") & F.col("b_correct"), "fixed").otherwise("same")
    return both.where(changed).withColumn("outcome", outcome)


def backtest_prior(rows: DataFrame, prior: DataFrame) -> DataFrame:
    """How the counterparty prior would have done on trusted labels, overall and on personal names."""
    seen = rows.where(F.col("source").isin(*TRUSTED) & F.col("counterparty_key").isNotNull()).select("id", "counterparty_key", "category")
    said = prior.select("id", F.col("category").alias("said"), "established")
    both = seen.join(said, "id", "left").withColumn("cohort", F.explode(F.when(personal_cohort(F.col("counterparty_key")), F.array(F.lit("overall"), F.lit("personal"))).otherwise(F.array(F.lit("overall")))))
    on = F.coalesce("established", F.lit(False))
    right = F.col("said") == F.col("category")
    out = both.groupBy("cohort").agg(F.count("*").alias("scored"), F.count(F.when(on, 1)).alias("established"), F.count(F.when(on & right, 1)).alias("correct"), F.count(F.when(on & ~right, 1)).alias("wrong"))
    return out.withColumn("coverage", four(F.col("established") / F.col("scored"))).withColumn("precision", F.when(F.col("established") > 0, four(F.col("correct") / F.col("established"))))


def sweep_thresholds(rows: DataFrame, prior: DataFrame, grid: DataFrame) -> DataFrame:
    """The same on personal names for each (min_obs, floor) of a small grid; the prior is computed once."""
    seen = rows.where(F.col("source").isin(*TRUSTED) & F.col("counterparty_key").isNotNull() & personal_cohort(F.col("counterparty_key"))).select("id", "category")
    both = seen.join(prior.select("id", "n_prior", "probability", F.col("category").alias("said")), "id", "left").crossJoin(F.broadcast(grid))
    on = F.coalesce((F.col("n_prior") >= F.col("min_obs")) & (F.col("probability") >= F.col("floor")), F.lit(False))
    out = both.groupBy("min_obs", "floor").agg(F.count("*").alias("scored"), F.count(F.when(on, 1)).alias("established"), F.count(F.when(on & (F.col("said") == F.col("category")), 1)).alias("correct"))
    return out.withColumn("coverage", four(F.col("established") / F.col("scored"))).withColumn("precision", F.when(F.col("established") > 0, four(F.col("correct") / F.col("established"))))


def decision_gate(backtest: DataFrame, least: int = 5, precision: float = 0.85) -> DataFrame:
    """PASS where enough were established and enough of them were right."""
    ok = (F.col("established") >= least) & (F.col("precision") >= precision)
    return backtest.select("cohort", "established", "precision", F.when(ok, "PASS").otherwise("FAIL").alias("verdict"))


def label_stability(runs: DataFrame) -> DataFrame:
    """Distinct labels of each transaction over runs."""
    out = runs.groupBy("transaction_id").agg(F.countDistinct("run").alias("runs"), F.countDistinct("category").alias("labels"))
    return out.withColumn("stable", F.col("labels") <= 1)


def causal_replay(gold: DataFrame, labels: DataFrame) -> DataFrame:
    """Evaluation records of causal cascade labels against the gold category; unlabelled rows are wrong."""
    out = gold.select(F.col("id").alias("transaction_id"), F.col("category").alias("gold")).join(labels.select(F.col("id").alias("transaction_id"), "category", "confidence", "stage"), "transaction_id", "left")
    return out.withColumn("correct", F.coalesce(F.col("category") == F.col("gold"), F.lit(False))).withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
