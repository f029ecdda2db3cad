"""Corrections, coverage, run summaries and evaluation over the derived ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.fixtures import duck
from ledgerloom.operators import coverage as CV
from ledgerloom.operators import evaluate as E
from ledgerloom.operators import feedback as FB
from ledgerloom.operators import rules as R
from ledgerloom.plans import label_plans as L
from ledgerloom.plans.base import ROWS, Ledger
from ledgerloom.registry import query

_REVIEW = "('llm', 'rag_prompted', 'rag_direct', 'learned_rule', 'rule', 'model')"


@query(duck(f"""SELECT ledger_id, id, rank, round(priority, 6) AS priority FROM (SELECT *, row_number() OVER (PARTITION BY ledger_id ORDER BY priority DESC, annotated_at, id) AS rank FROM (
  SELECT *, round((1 - confidence) * ln(1 + CAST(amount AS DOUBLE)), 8) AS priority FROM r WHERE source IN {_REVIEW} AND confidence < 0.85)) WHERE rank <= 50""", r=ROWS))
def review_queue(spark, sf_dir):
    return FB.review_queue(Ledger(spark, sf_dir).rows, 50).select("ledger_id", "id", "rank", F.round("priority", 6).alias("priority"))


@query(duck("""SELECT id, CASE WHEN k % 10 = 0 THEN 'Health' ELSE category END AS category, CASE WHEN k % 10 = 0 THEN NULL ELSE subcategory END AS subcategory, merchant, CASE WHEN k % 5 = 0 THEN 1.0 ELSE confidence END AS confidence,
CASE WHEN k % 5 = 0 THEN 'manual' ELSE source END AS source, CASE WHEN k % 5 = 0 AND source <> 'manual' THEN coalesce(original_source, source) ELSE original_source END AS original_source FROM annotations"""))
def apply_corrections(spark, sf_dir):
    anns = Ledger(spark, sf_dir).annotations
    sent = F.when(F.col("k") % 10 == 0, F.array(F.lit("category"), F.lit("subcategory"))).otherwise(F.array().cast("array<string>"))
    none = F.lit(None).cast("string")
    edits = anns.where("k % 5 = 0").select(F.col("id").alias("annotation_id"), sent.alias("sent"), F.lit("Health").alias("category"), none.alias("subcategory"), none.alias("merchant"), F.lit(None).cast("array<string>").alias("tags"), F.lit(None).cast("double").alias("confidence"))
    return FB.apply_corrections(anns, edits).select("id", "category", "subcategory", "merchant", "confidence", "source", "original_source")


@query(duck("SELECT * FROM fc", fc=L._FEED))
def feedback_counts(spark, sf_dir):
    return FB.feedback_counts(Ledger(spark, sf_dir).feedback_events)


@query(duck("SELECT source, category, CAST(2 * confirmed AS BIGINT) AS confirmed, CAST(2 * refined AS BIGINT) AS refined, CAST(2 * corrected AS BIGINT) AS corrected FROM fc", fc=L._FEED))
def merge_feedback(spark, sf_dir):
    counts = FB.feedback_counts(Ledger(spark, sf_dir).feedback_events)
    return FB.merge_feedback(counts, counts)


_SIM = {**L._KNN, "dn": "SELECT id, ledger_id, counterparty_key, category, subcategory FROM r WHERE source = 'manual'", "cs": "SELECT query_id AS donor_id, transaction_id AS id, similarity FROM nn WHERE similarity >= 0.30"}


@query(duck("""SELECT donor_id, id, category, source, similarity, differs, row_number() OVER (PARTITION BY donor_id ORDER BY differs DESC, similarity DESC, id) AS rank FROM (
  SELECT c.donor_id, c.id, r.category, r.source, similarity, NOT (r.category IS NOT DISTINCT FROM d.category AND r.subcategory IS NOT DISTINCT FROM d.subcategory) AS differs
  FROM cs c JOIN r ON r.id = c.id AND r.source IN ('llm', 'rag_prompted', 'rag_direct', 'learned_rule') JOIN dn d ON d.id = c.donor_id)""", **_SIM))
def similar_candidates(spark, sf_dir):
    t, near = L._knn(spark, sf_dir)
    return FB.similar_candidates(t.rows, t.rows.where("source = 'manual'"), near, L.LOW)


@query(duck("""SELECT ledger_id, counterparty_key, id, category, subcategory, part FROM (SELECT *, CASE WHEN source = 'manual' THEN 'donor' WHEN source IN ('llm', 'rag_prompted', 'rag_direct', 'learned_rule') THEN 'candidate' END AS part FROM r WHERE counterparty_key IS NOT NULL)
WHERE part IS NOT NULL QUALIFY count(DISTINCT part) OVER (PARTITION BY ledger_id, counterparty_key) = 2""", r=ROWS))
def similar_groups(spark, sf_dir):
    rows = Ledger(spark, sf_dir).rows
    return FB.similar_groups(rows, rows.where("source = 'manual'"))


@query(duck("""SELECT a.id, CASE WHEN m.id IS NULL THEN a.category ELSE dc END AS category, CASE WHEN m.id IS NULL THEN a.source ELSE 'manual' END AS source, CASE WHEN m.id IS NULL THEN a.confidence ELSE 1.0 END AS confidence
FROM annotations a LEFT JOIN (SELECT t.id, d.category AS dc FROM transactions t JOIN (SELECT ledger_id, arg_min(category, id) AS category FROM r WHERE source = 'manual' GROUP BY 1) d ON d.ledger_id = t.ledger_id JOIN r x ON x.id = t.id WHERE t.k % 7 = 0 AND x.source IN ('llm', 'rag_prompted', 'rag_direct', 'learned_rule')) m ON m.id = a.transaction_id""", r=ROWS))
def apply_to_similar(spark, sf_dir):
    t = Ledger(spark, sf_dir)
    donor = t.rows.where("source = 'manual'").groupBy("ledger_id").agg(F.min("id").alias("donor_id"))
    after, _ = FB.apply_to_similar(t.annotations, t.transactions.where("k % 7 = 0").join(donor, "ledger_id").select("donor_id", "id"))
    return after.select("id", "category", "source", "confidence")


@query(duck("SELECT a.id, p.id AS category_id, s.id AS subcategory_id FROM annotations a LEFT JOIN categories p ON p.name = a.category AND p.parent_id IS NULL LEFT JOIN categories s ON s.parent_id = p.id AND s.name = a.subcategory"))
def resolve_category_ids(spark, sf_dir):
    t = Ledger(spark, sf_dir)
    return FB.resolve_category_ids(t.annotations, t.categories).select("id", "category_id", "subcategory_id")


@query(duck("SELECT id, CASE WHEN category = 'Miscellaneous' THEN 'Shopping' ELSE category END AS category, CASE WHEN category = 'Food & Dining' AND subcategory = 'Dining' THEN 'Restaurants' ELSE subcategory END AS subcategory FROM annotations"))
def relabel(spark, sf_dir):
    mapping = spark.sql("SELECT 'Miscellaneous' AS category, CAST(NULL AS STRING) AS subcategory, 'Shopping' AS new_category, CAST(NULL AS STRING) AS new_subcategory UNION ALL SELECT 'Food & Dining', 'Dining', 'Food & Dining', 'Restaurants'")
    return FB.relabel(Ledger(spark, sf_dir).annotations, mapping).select("id", "category", "subcategory")


# -- coverage -------------------------------------------------------------------------------


@query(duck("SELECT s.id AS statement_id, s.ledger_id, s.statement_month, count(DISTINCT t.id) AS transactions, count(DISTINCT a.transaction_id) AS annotated, count(DISTINCT v.transaction_id) AS embedded FROM statements s LEFT JOIN transactions t ON t.statement_id = s.id LEFT JOIN annotations a ON a.transaction_id = t.id LEFT JOIN vectors v ON v.transaction_id = t.id GROUP BY ALL"))
def statement_coverage(spark, sf_dir):
    t = Ledger(spark, sf_dir)
    return CV.statement_coverage(t.statements, t.transactions, t.annotations, t.vectors)


@query(duck("SELECT m.group_id, m.transaction_id, CAST(t.amount AS DOUBLE) AS amount, count(*) OVER (PARTITION BY m.group_id) AS members, row_number() OVER (PARTITION BY m.group_id ORDER BY t.txn_date, m.transaction_id) AS place FROM transaction_group_members m JOIN transactions t ON t.id = m.transaction_id"))
def group_members(spark, sf_dir):
    t = Ledger(spark, sf_dir)
    return CV.group_members(t.transaction_group_members, t.transactions).select("group_id", "transaction_id", F.col("amount").cast("double").alias("amount"), "members", "place")


def _tables(t):
    return {"transactions": t.transactions, "statements": t.statements, "annotations": t.annotations, "vectors": t.vectors, "links": t.transaction_links, "members": t.transaction_group_members}


def _counts(tables):
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.union(one)
    return out


_GONE = "SELECT id FROM transactions WHERE ledger_id % 4 = 1"
_LEFT = """SELECT 'annotations' AS name, count(*) AS rows FROM annotations WHERE transaction_id NOT IN (SELECT id FROM g) UNION ALL SELECT 'vectors', count(*) FROM vectors WHERE transaction_id NOT IN (SELECT id FROM g)
UNION ALL SELECT 'links', count(*) FROM transaction_links WHERE txn_a NOT IN (SELECT id FROM g) AND txn_b NOT IN (SELECT id FROM g) UNION ALL SELECT 'members', count(*) FROM transaction_group_members WHERE transaction_id NOT IN (SELECT id FROM g)"""


@query(duck(f"{_LEFT} UNION ALL SELECT 'transactions', count(*) FROM transactions WHERE ledger_id % 4 <> 1 UNION ALL SELECT 'statements', count(*) FROM statements WHERE ledger_id % 4 <> 1", g=_GONE))
def delete_statements(spark, sf_dir):
    t = Ledger(spark, sf_dir)
    return _counts(CV.delete_statements(t.statements.where("ledger_id % 4 = 1").select("id"), _tables(t)))


@query(duck(f"{_LEFT} UNION ALL SELECT 'transactions', count(*) FROM transactions UNION ALL SELECT 'statements', count(*) FROM statements", g=_GONE))
def reset_statements(spark, sf_dir):
    t = Ledger(spark, sf_dir)
    return _counts(CV.reset_statements(t.statements.where("ledger_id % 4 = 1").select("id"), _tables(t)))


_MODEL = "('llm', 'rag_prompted', 'rag_direct', 'learned_rule', 'rule')"


@query(duck(f"SELECT *, CAST(round(CAST(review / CAST(count AS DOUBLE) AS DECIMAL(28,8)), 4) AS DOUBLE) AS review_rate FROM (SELECT ledger_id, source, count(*) AS count, count(*) FILTER (WHERE confidence >= 0.85) AS auto_accepted, count(*) FILTER (WHERE confidence < 0.85) AS review FROM r WHERE source IN {_MODEL} GROUP BY GROUPING SETS ((ledger_id, source), (ledger_id)))", r=ROWS))
def stage_funnel(spark, sf_dir):
    return CV.stage_funnel(Ledger(spark, sf_dir).rows)


@query(duck(f"""SELECT l.ledger_id, k.kind, CAST(b.bin AS INT) AS bin, coalesce(n, 0) AS count FROM (SELECT DISTINCT ledger_id FROM transactions) l, (SELECT unnest(['confidence', 'similarity']) AS kind) k, (SELECT unnest(range(20)) AS bin) b
LEFT JOIN (SELECT ledger_id, kind, least(greatest(floor(v * 20), 0), 19) AS bin, count(*) AS n FROM (SELECT ledger_id, 'confidence' AS kind, confidence AS v FROM r WHERE source IN {_MODEL} UNION ALL SELECT ledger_id, 'similarity', best_similarity FROM r WHERE source IN {_MODEL} AND best_similarity IS NOT NULL) GROUP BY ALL) c
ON c.ledger_id = l.ledger_id AND c.kind = k.kind AND c.bin = b.bin""", r=ROWS))
def score_histogram(spark, sf_dir):
    return CV.score_histogram(Ledger(spark, sf_dir).rows)


@query(duck(f"""SELECT ledger_id, kind, rank, id, category, source, round(v, 4) AS value FROM (SELECT *, row_number() OVER (PARTITION BY ledger_id, kind ORDER BY v DESC, id) AS rank FROM (
  SELECT ledger_id, id, category, source, 'confidence' AS kind, confidence AS v FROM r WHERE source IN {_MODEL} AND confidence < 0.85::DOUBLE AND confidence >= 0.85::DOUBLE - 0.05::DOUBLE
  UNION ALL SELECT ledger_id, id, category, source, 'similarity', best_similarity FROM r WHERE source IN {_MODEL} AND best_similarity < 0.92::DOUBLE AND best_similarity >= 0.92::DOUBLE - 0.05::DOUBLE)) WHERE rank <= 15""", r=ROWS))
def near_misses(spark, sf_dir):
    return CV.near_misses(Ledger(spark, sf_dir).rows)


# -- evaluation -----------------------------------------------------------------------------

_REC = "SELECT p.transaction_id, CASE WHEN k % 2 = 0 THEN 'a' ELSE 'b' END AS run, p.stage, p.category, p.confidence, coalesce(p.category = r.category, false) AS correct, CASE WHEN k % 10 < 9 THEN (k * 7 % 900) / 1000.0::DOUBLE END AS latency_s FROM predictions p JOIN r ON r.id = p.transaction_id WHERE r.source = 'manual'"


def _records(t):
    gold = t.rows.where("source = 'manual'").select(F.col("id").alias("transaction_id"), F.col("category").alias("gold"), "k")
    run = F.when(F.col("k") % 2 == 0, "a").otherwise("b")
    return t.predictions.join(gold, "transaction_id").select("transaction_id", run.alias("run"), "stage", "category", "confidence", F.coalesce(F.col("category") == F.col("gold"), F.lit(False)).alias("correct"), F.when(F.col("k") % 10 < 9, F.col("k") * 7 % 900 / 1000.0).alias("latency_s"))


def _four(x: str) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(28,8)), 4) AS DOUBLE)"


_METRICS = f"""SELECT run, stage, n, {_four("n / CAST(max(n) OVER (PARTITION BY run) AS DOUBLE)")} AS coverage, {_four("ok / CAST(n AS DOUBLE)")} AS accuracy, {_four("b / CAST(n AS DOUBLE)")} AS brier, {_four("an / CAST(n AS DOUBLE)")} AS auto_accept_rate, CASE WHEN an > 0 THEN {_four("ao / CAST(an AS DOUBLE)")} END AS auto_accept_precision, {_four("(n - an) / CAST(n AS DOUBLE)")} AS review_rate,
CAST(round(CAST(lt / ln AS DECIMAL(20,8)), 3) AS DOUBLE) AS mean_latency_s
FROM (SELECT run, stage, count(*) AS n, sum(correct::INT) AS ok, sum(CAST(round(pow(confidence - correct::INT, 2), 10) AS DECIMAL(20,10)))::DOUBLE AS b, count(*) FILTER (WHERE confidence >= 0.85) AS an, count(*) FILTER (WHERE confidence >= 0.85 AND correct) AS ao, sum(CAST(latency_s AS DECIMAL(14,6)))::DOUBLE AS lt, count(latency_s) AS ln FROM rec GROUP BY GROUPING SETS ((run, stage), (run)))"""


@query(duck("SELECT * FROM mt", r=ROWS, rec=_REC, mt=_METRICS))
def eval_metrics(spark, sf_dir):
    return E.eval_metrics(_records(Ledger(spark, sf_dir)))


_REPORT = """SELECT stage, metric, max(v) FILTER (WHERE run = 'a') AS before, max(v) FILTER (WHERE run = 'b') AS after,
  CAST(round(CAST(max(v) FILTER (WHERE run = 'b') AS DECIMAL(20,6)) - CAST(max(v) FILTER (WHERE run = 'a') AS DECIMAL(20,6)), 4) AS DOUBLE) AS delta,
  metric IN ('accuracy', 'auto_accept_precision') AND count(*) = 2 AND CAST(coalesce(max(v) FILTER (WHERE run = 'a'), 0) AS DECIMAL(20,6)) - CAST(coalesce(max(v) FILTER (WHERE run = 'b'), 0) AS DECIMAL(20,6)) > 0.0001 AS regressed
FROM (SELECT run, stage, unnest(['coverage', 'brier', 'auto_accept_rate', 'review_rate', 'mean_latency_s', 'accuracy', 'auto_accept_precision']) AS metric, unnest([coverage, brier, auto_accept_rate, review_rate, mean_latency_s, accuracy, auto_accept_precision]) AS v FROM mt) GROUP BY stage, metric"""


@query(duck(_REPORT, r=ROWS, rec=_REC, mt=_METRICS))
def eval_report(spark, sf_dir):
    return E.eval_report(E.eval_metrics(_records(Ledger(spark, sf_dir))), "a", "b", 0.0001)


@query(duck("SELECT count(*) > 0 AS regressed, coalesce(string_agg(metric, ',' ORDER BY metric), '') AS metrics FROM rp WHERE stage IS NULL AND regressed", r=ROWS, rec=_REC, mt=_METRICS, rp=_REPORT))
def eval_regression(spark, sf_dir):
    report = E.eval_report(E.eval_metrics(_records(Ledger(spark, sf_dir))), "a", "b", 0.0001)
    return E.regression(report).withColumn("metrics", F.array_join("metrics", ","))


@query(duck("""SELECT a.transaction_id, a.category AS a_category, a.stage AS a_stage, a.correct AS a_correct, CASE WHEN x % 4 = 0 THEN 'Health' ELSE a.category END AS b_category, a.stage AS b_stage, CASE WHEN x % 4 = 0 THEN NOT a.correct ELSE a.correct END AS b_correct,
CASE WHEN a.correct THEN 'regressed' ELSE 'fixed' END AS outcome FROM (SELECT *, CAST(transaction_id AS BIGINT) AS x FROM rec) a WHERE x % 4 = 0""", r=ROWS, rec=_REC))
def eval_diff(spark, sf_dir):
    a = _records(Ledger(spark, sf_dir))
    x = F.col("transaction_id").cast("long") % 4 == 0
    b = a.withColumn("category", F.when(x, "Health").otherwise(F.col("category"))).withColumn("correct", F.when(x, ~F.col("correct")).otherwise(F.col("correct")))
    return E.eval_diff(a, b)


_HINTS = "('SWIGGY', 'ZOMATO', 'ZOMATO LIMITED', 'UBER')"
_BACK = {
    **L._PRIOR,
    "sc": f"SELECT r.id, r.category, r.counterparty_key NOT IN {_HINTS} AS personal, pr.category AS said, n_prior, probability, coalesce(established, false) AS est FROM r LEFT JOIN pr ON pr.id = r.id WHERE source IN ('manual', 'rule', 'imported') AND r.counterparty_key IS NOT NULL",
    "bt": f"""SELECT *, {_four("established / CAST(scored AS DOUBLE)")} AS coverage, CASE WHEN established > 0 THEN {_four("correct / CAST(established AS DOUBLE)")} END AS precision FROM (
      SELECT cohort, count(*) AS scored, count(*) FILTER (WHERE est) AS established, count(*) FILTER (WHERE est AND said = category) AS correct, count(*) FILTER (WHERE est AND said <> category) AS wrong
      FROM (SELECT *, 'overall' AS cohort FROM sc UNION ALL SELECT *, 'personal' FROM sc WHERE personal) GROUP BY ALL)""",
}


def _backtest(t):
    return E.backtest_prior(t.rows, R.counterparty_prior(t.rows))


@query(duck("SELECT * FROM bt", **_BACK))
def backtest_prior(spark, sf_dir):
    return _backtest(Ledger(spark, sf_dir))


@query(duck(f"""SELECT *, {_four("established / CAST(scored AS DOUBLE)")} AS coverage, CASE WHEN established > 0 THEN {_four("correct / CAST(established AS DOUBLE)")} END AS precision FROM (
  SELECT CAST(m AS INT) AS min_obs, f AS floor, count(*) AS scored, count(*) FILTER (WHERE n_prior >= m AND probability >= f) AS established, count(*) FILTER (WHERE n_prior >= m AND probability >= f AND said = category) AS correct
  FROM sc, (SELECT unnest([2, 3, 4, 5]) AS m), (SELECT unnest([0.5::DOUBLE, 0.6::DOUBLE, 0.65::DOUBLE, 0.7::DOUBLE]) AS f) WHERE personal GROUP BY ALL)""", **_BACK))
def sweep_thresholds(spark, sf_dir):
    t = Ledger(spark, sf_dir)
    grid = spark.createDataFrame([(m, f) for m in (2, 3, 4, 5) for f in (0.5, 0.6, 0.65, 0.7)], "min_obs int, floor double")
    return E.sweep_thresholds(t.rows, R.counterparty_prior(t.rows), grid)


@query(duck("SELECT cohort, established, precision, CASE WHEN established >= 5 AND precision >= 0.85 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM bt", **_BACK))
def decision_gate(spark, sf_dir):
    return E.decision_gate(_backtest(Ledger(spark, sf_dir)))


@query(duck("SELECT transaction_id, count(DISTINCT run) AS runs, count(DISTINCT category) AS labels, count(DISTINCT category) <= 1 AS stable FROM (SELECT transaction_id, 1 AS run, category FROM annotations UNION ALL SELECT transaction_id, 2, category FROM predictions) GROUP BY ALL"))
def label_stability(spark, sf_dir):
    t = Ledger(spark, sf_dir)
    runs = t.annotations.select("transaction_id", F.lit(1).alias("run"), "category").union(t.predictions.select("transaction_id", F.lit(2), "category"))
    return E.label_stability(runs)


@query(duck("""SELECT r.id AS transaction_id, r.category AS gold, ca.category, coalesce(ca.confidence, 0) AS confidence, ca.stage, coalesce(ca.category = r.category, false) AS correct
FROM r LEFT JOIN ca ON ca.id = r.id WHERE r.source = 'manual'""", **L._CASCADE_CAUSAL))
def causal_replay(spark, sf_dir):
    t = Ledger(spark, sf_dir)
    return E.causal_replay(t.rows.where("source = 'manual'"), L.cascade_labels(t, causal=True))
