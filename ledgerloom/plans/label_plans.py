"""Rules, priors, neighbours, scores and the cascade over the derived ledger."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ledgerloom.fixtures import checkpointed, duck
from ledgerloom.functions import scalars as S
from ledgerloom.operators import cascade as C
from ledgerloom.operators import feedback as FB
from ledgerloom.operators import neighbours as N
from ledgerloom.operators import rules as R
from ledgerloom.operators import votes as V
from ledgerloom.plans.base import ROWS, Ledger
from ledgerloom.registry import query
from ledgerloom.thresholds import Thresholds

CATEGORIES = ["Entertainment", "Food & Dining", "Health", "Income", "Investments", "Miscellaneous", "Self Transfers", "Subscriptions", "Transfers", "Transport"]
#: The vectors given are far apart, so the gates are low here.
LOW = Thresholds(similarity_floor=0.30, rag_direct=0.30, apply_similar_floor=0.30)
#: Verified labels are the manual ones; few ledgers have many, so three of them suffice as by default.
TH = Thresholds()


def _alt(patterns) -> str:
    words = "|".join(re.escape(p).replace("\\ ", " ").replace("'", "''") for p in patterns)
    return f"(^|[^\\w])({words})($|[^\\w])"


def _case(value: int) -> str:
    quote = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    out = "CASE"
    for base, override, *label in R.DISAMBIGUATION_RULES:
        out += f" WHEN regexp_matches(hay, '{_alt(base)}') AND regexp_matches(hay, '{_alt(override)}') THEN {quote(label[value])}"
    for patterns, *label in R.KEYWORD_RULES:
        out += f" WHEN regexp_matches({'low' if len(label) > 4 else 'hay'}, '{_alt(patterns)}') THEN {quote(label[value])}"
    return out + " END"


_HAY = "SELECT id, ledger_id, lower(raw_description) AS low, lower(raw_description) || ' ' || lower(coalesce(note, '')) AS hay FROM transactions"
_KEYWORD = f"SELECT id, {_case(0)} AS category, {_case(1)} AS subcategory, {_case(2)} AS merchant FROM h"


@query(duck(_KEYWORD, h=_HAY))
def match_keyword_rules(spark, sf_dir):
    return R.match_keyword_rules(Ledger(spark, sf_dir).transactions).select("id", "label.category", "label.subcategory", "label.merchant")


@query(duck("SELECT id, CASE " + " ".join(f"WHEN regexp_matches(hay, '{_alt(b)}') AND regexp_matches(hay, '{_alt(o)}') THEN '{m}'" for b, o, _, _, m, _ in R.DISAMBIGUATION_RULES) + " END AS merchant FROM h", h=_HAY))
def match_disambiguation_rules(spark, sf_dir):
    return R.match_disambiguation_rules(Ledger(spark, sf_dir).transactions).select("id", F.col("label.merchant").alias("merchant"))


_PEOPLE = """SELECT id, person_id, name, subcategory FROM (SELECT t.id, p.id AS person_id, p.name, CASE p.relationship WHEN 'mom' THEN 'Family' ELSE 'Peer Transfer' END AS subcategory,
  row_number() OVER (PARTITION BY t.id ORDER BY p.name, p.id) AS n
  FROM transactions t JOIN (SELECT ledger_id, id, name, relationship, name AS token FROM people UNION SELECT ledger_id, id, name, relationship, upi FROM people) p ON p.ledger_id = t.ledger_id AND length(token) >= 3
  WHERE CASE WHEN contains(token, '@') THEN CASE WHEN vpa IS NOT NULL THEN vpa = token ELSE contains(lower(raw_description), token) END
    WHEN counterparty_key IS NOT NULL THEN len(list_filter(string_split(lower(counterparty_key), ' '), lambda w: starts_with(w, token))) > 0
    ELSE regexp_matches(lower(raw_description), '\\b' || regexp_replace(token, '([^a-z0-9_ ])', '\\\\\\1', 'g')) END) WHERE n = 1"""


@query(duck(_PEOPLE))
def match_people(spark, sf_dir):
    t = Ledger(spark, sf_dir)
    return R.match_people(t.transactions, t.people)


_VER = "SELECT * FROM r WHERE source IN ('manual', 'imported') AND counterparty_key IS NOT NULL AND category IS NOT NULL"
_LEARNED = {
    "r": ROWS, "vr": _VER,
    "lc": "SELECT ledger_id, counterparty_key, category, count(*) AS support, arg_max(coalesce(subcategory, ''), (annotated_at, id)) AS subcategory, arg_max(coalesce(merchant, ''), (annotated_at, id)) AS merchant FROM vr GROUP BY ALL",
    "lr": """SELECT ledger_id, counterparty_key, category, nullif(subcategory, '') AS subcategory, nullif(merchant, '') AS merchant, support, CAST(total AS BIGINT) AS total, CAST(round(CAST(support / CAST(total AS DOUBLE) AS DECIMAL(28,8)), 4) AS DOUBLE) AS purity
      FROM (SELECT *, sum(support) OVER (PARTITION BY ledger_id, counterparty_key) AS total, row_number() OVER (PARTITION BY ledger_id, counterparty_key ORDER BY support DESC, category) AS n FROM lc) WHERE n = 1 AND support >= 3 AND support / CAST(total AS DOUBLE) >= 0.9""",
}


@query(duck("SELECT * FROM lr", **_LEARNED))
def learned_rules(spark, sf_dir):
    return R.learned_rules(Ledger(spark, sf_dir).rows).drop("tags")


@query(duck("SELECT ledger_id, counterparty_key, category FROM lr WHERE counterparty_key NOT IN ('UBER') OR ledger_id % 2 = 0", **_LEARNED))
def apply_suppressions(spark, sf_dir):
    t = Ledger(spark, sf_dir)
    keys = t.transactions.where("counterparty_key = 'UBER'").select("ledger_id", "counterparty_key")
    off = R.edit_suppressions(keys.limit(0), keys, keys.where("ledger_id % 2 = 0"))
    return R.apply_suppressions(R.learned_rules(t.rows), off).select("ledger_id", "counterparty_key", "category")


_ASOF = """SELECT ledger_id, id, counterparty_key, category, support, CAST(total AS BIGINT) AS total FROM (SELECT *, sum(support) OVER (PARTITION BY id) AS total, row_number() OVER (PARTITION BY id ORDER BY support DESC, category) AS n FROM
  (SELECT x.ledger_id, x.id, x.counterparty_key, v.category, count(*) AS support FROM transactions x JOIN vr v ON v.ledger_id = x.ledger_id AND v.counterparty_key = x.counterparty_key AND v.txn_date < x.txn_date GROUP BY ALL))
  WHERE n = 1 AND support >= 3 AND support / CAST(total AS DOUBLE) >= 0.9"""


@query(duck("SELECT * FROM lra", r=ROWS, vr=_VER, lra=_ASOF))
def learned_rule_asof(spark, sf_dir):
    return R.learned_rule_asof(Ledger(spark, sf_dir).rows)


_PRIOR = {
    "r": ROWS,
    "hw": """SELECT x.ledger_id, x.id, x.counterparty_key, h.category, count(*) AS n, sum(CASE WHEN h.source IN ('manual', 'rule', 'imported') THEN 1.0 ELSE 0.25 END)::DOUBLE AS w
      FROM transactions x JOIN r h ON h.ledger_id = x.ledger_id AND h.counterparty_key = x.counterparty_key AND h.txn_date < x.txn_date AND h.category IS NOT NULL GROUP BY ALL""",
    "hp": """SELECT *, sum(w) OVER p AS wt, sum(n) OVER p AS np, count(*) OVER p AS kk, row_number() OVER (PARTITION BY id ORDER BY w DESC, category) AS rn FROM hw WINDOW p AS (PARTITION BY id)""",
    "pr": """SELECT ledger_id, id, counterparty_key, n_prior, weight, category, probability, n_prior >= 2 AND probability >= 0.65 AS established FROM (SELECT ledger_id, id, counterparty_key, CAST(np AS BIGINT) AS n_prior, round(wt, 4) AS weight, category,
      CAST(round(CAST((2.0 / kk + w) / (2.0 + wt) AS DECIMAL(28,8)), 4) AS DOUBLE) AS probability FROM hp WHERE rn = 1)""",
}


@query(duck("SELECT * FROM pr", **_PRIOR))
def counterparty_prior(spark, sf_dir):
    return R.counterparty_prior(Ledger(spark, sf_dir).rows)


_OPEN = {"r0": ROWS, "r": "SELECT * REPLACE (category || coalesce(' / ' || merchant, '') || CASE WHEN k % 1009 = 5 THEN ' ' || id ELSE '' END AS category) FROM r0"}


def _open(t: Ledger):
    """Labels whose categories are open: finer by merchant, and some that occur once."""
    once = F.when(F.col("k") % 1009 == 5, F.concat(F.lit(" "), "id")).otherwise("")
    return t.rows.withColumn("category", F.concat("category", F.coalesce(F.concat(F.lit(" / "), "merchant"), F.lit("")), once))


@query(duck("SELECT * FROM pr", **{**_OPEN, **{k: v for k, v in _PRIOR.items() if k != "r"}}))
def counterparty_prior_open(spark, sf_dir):
    return R.counterparty_prior(_open(Ledger(spark, sf_dir)))


@query(duck("SELECT * FROM lra", **_OPEN, vr=_VER, lra=_ASOF))
def learned_rule_asof_open(spark, sf_dir):
    return R.learned_rule_asof(_open(Ledger(spark, sf_dir)))


_GATE = "SELECT m.id, 'Transfers' AS category, m.subcategory, CASE WHEN p.category <> 'Transfers' THEN 0.5::DOUBLE ELSE 0.95::DOUBLE END AS confidence, 'rule' AS source, m.name AS merchant, coalesce(p.category <> 'Transfers', false) AS gated FROM mp m LEFT JOIN (SELECT * FROM pr WHERE established) p ON p.id = m.id"


@query(duck(_GATE, **_PRIOR, mp=_PEOPLE))
def person_history_gate(spark, sf_dir):
    t = Ledger(spark, sf_dir)
    return C.person_history_gate(R.match_people(t.transactions, t.people), R.counterparty_prior(t.rows))


# -- neighbours -----------------------------------------------------------------------------

_VEC = "SELECT x.transaction_id AS id, x.vec_id % 3 AS ledger_id, (x.vec_id // 7) % 2 AS model, x.vec_id, list_transform(x.embedding, lambda x: CAST(x AS DOUBLE)) AS e, t.txn_date AS day FROM vectors x LEFT JOIN transactions t ON t.id = x.transaction_id"
_KNN = {
    "r": ROWS, "v": _VEC,
    "nn": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ledger_id, query_id ORDER BY similarity DESC, transaction_id) AS rank FROM (
      SELECT q.ledger_id, q.id AS query_id, d.id AS transaction_id, round(list_cosine_similarity(q.e, d.e), 6) AS similarity FROM v q JOIN v d ON d.ledger_id = q.ledger_id AND d.model = q.model AND d.id <> q.id WHERE q.vec_id % 20 = 0)) WHERE rank <= 5""",
    "ng": "SELECT *, max(similarity) OVER (PARTITION BY ledger_id, query_id) AS best FROM nn QUALIFY best >= 0.30",
    "dl": "SELECT ng.*, category, subcategory, merchant, source, vpa, raw_description FROM ng JOIN r ON r.id = ng.transaction_id AND r.annotation_id IS NOT NULL",
    "dd": "SELECT * FROM dl QUALIFY row_number() OVER (PARTITION BY ledger_id, query_id, CASE WHEN vpa <> '' THEN 'vpa:' || lower(vpa) WHEN trim(merchant) <> '' THEN 'merchant:' || lower(trim(merchant)) ELSE 'desc:' || lower(trim(raw_description)) END ORDER BY similarity DESC, transaction_id) = 1",
    "tp": "SELECT *, arg_max(category, (similarity, -CAST(transaction_id AS BIGINT))) OVER (PARTITION BY ledger_id, query_id) AS top FROM dd",
    "ag": "SELECT ledger_id, query_id, CASE WHEN avg((category = top)::INT) >= 1 THEN 1.0 ELSE pow(avg((category = top)::INT), 0.3) END::DOUBLE AS agreement FROM tp GROUP BY ALL",
    "mg": """SELECT ledger_id, query_id, CASE WHEN g IS NULL OR g >= 0.08 THEN 1.0::DOUBLE ELSE CAST(0.85 + 1.875 * g AS DOUBLE) END AS margin FROM (SELECT ledger_id, query_id, max(similarity::DECIMAL(10,6)) - max(similarity::DECIMAL(10,6)) FILTER (WHERE category <> top) AS g FROM tp GROUP BY ALL)""",
}
#: The same with donors of strictly earlier days alone.
_CAUSAL = {**_KNN, "nn": _KNN["nn"].replace("d.id <> q.id WHERE", "d.id <> q.id AND d.day < q.day WHERE")}


def _near(t: Ledger, causal: bool = False, left=None, block: int = N.BLOCK):
    """Neighbours in all vectors of the same ledger and model: of every vector whose number 20 divides, or of the rows ``left``."""
    model = (F.floor(F.col("vec_id") / 7) % 2).alias("model_version")
    v = t.vectors.select(F.col("transaction_id").alias("id"), (F.col("vec_id") % 3).alias("ledger_id"), model, "vec_id", "embedding")
    if causal:
        v = v.join(t.transactions.select("id", F.col("txn_date").alias("day")), "id")
    asked = v.where("vec_id % 20 = 0") if left is None else v.join(left.select("id"), "id", "left_semi")
    return checkpointed(N.knn(asked.drop("vec_id"), v.drop("vec_id"), causal=causal, block=block, keep=checkpointed))


def _knn(spark, sf_dir):
    t = Ledger(spark, sf_dir)
    return t, _near(t)


def _gated(t, near):
    gated = V.novelty_gate(near, LOW)
    return gated, checkpointed(V.dedup_donors(V.attach_donor_labels(gated, t.rows)))


def _donors(spark, sf_dir):
    t, near = _knn(spark, sf_dir)
    return t, *_gated(t, near)


@query(duck("SELECT ledger_id, query_id, transaction_id, similarity, rank FROM nn", **_KNN))
def knn(spark, sf_dir):
    return _knn(spark, sf_dir)[1]


@query(duck("SELECT ledger_id, query_id, transaction_id, similarity, rank FROM nn", **_CAUSAL))
def knn_causal(spark, sf_dir):
    return _near(Ledger(spark, sf_dir), causal=True)


@query(duck("SELECT ledger_id, query_id, transaction_id, similarity, rank FROM nn", **_KNN))
def knn_indexed(spark, sf_dir):
    """The same through the metric index, whose clusters are small enough here that each ledger has several."""
    return _near(Ledger(spark, sf_dir), block=32)


@query(duck("SELECT ledger_id, query_id, transaction_id, best FROM ng", **_KNN))
def novelty_gate(spark, sf_dir):
    return _donors(spark, sf_dir)[1].select("ledger_id", "query_id", "transaction_id", "best")


@query(duck("SELECT query_id, transaction_id, category, source, vpa FROM dl", **_KNN))
def attach_donor_labels(spark, sf_dir):
    t, near = _knn(spark, sf_dir)
    return V.attach_donor_labels(V.novelty_gate(near, LOW), t.rows).select("query_id", "transaction_id", "category", "source", "vpa")


@query(duck("SELECT query_id, transaction_id, similarity FROM dd", **_KNN))
def dedup_donors(spark, sf_dir):
    return _donors(spark, sf_dir)[2].select("query_id", "transaction_id", "similarity")


_VOTE = """SELECT ledger_id, query_id, category AS vote, round(w / tot, 4) AS vote_share, trusted AS trusted_weight FROM (SELECT *, sum(w) OVER p AS tot, sum(t) OVER p AS trusted, row_number() OVER (PARTITION BY ledger_id, query_id ORDER BY w DESC, category) AS n FROM (
  SELECT ledger_id, query_id, category, sum(CASE WHEN source IN ('manual', 'rule', 'imported') THEN 1.0 ELSE 0.25 END)::DOUBLE AS w, sum(CASE WHEN source IN ('manual', 'rule', 'imported') THEN 1.0 ELSE 0.0 END)::DOUBLE AS t FROM dd WHERE category IS NOT NULL GROUP BY ALL) WINDOW p AS (PARTITION BY ledger_id, query_id)) WHERE n = 1"""


@query(duck(_VOTE, **_KNN))
def weighted_vote(spark, sf_dir):
    return V.weighted_vote(_donors(spark, sf_dir)[2])


@query(duck("SELECT ledger_id, query_id, round(agreement, 6) AS agreement FROM ag", **_KNN))
def agreement_factor(spark, sf_dir):
    return V.agreement_factor(_donors(spark, sf_dir)[2]).withColumn("agreement", F.round("agreement", 6))


@query(duck("SELECT ledger_id, query_id, CAST(round(CAST(margin AS DECIMAL(12,9)), 6) AS DOUBLE) AS margin FROM mg", **_KNN))
def margin_factor(spark, sf_dir):
    exact = F.col("margin").cast("decimal(12,9)")  # nine places hold it whole, so a tie is a tie
    return V.margin_factor(_donors(spark, sf_dir)[2]).withColumn("margin", F.round(exact, 6).cast("double"))


_RAG = """SELECT ledger_id, query_id, category, transaction_id AS donor_id, CAST(round(CAST(best * agreement * margin AS DECIMAL(28,10)), 4) AS DOUBLE) AS confidence
FROM (SELECT * FROM dd QUALIFY row_number() OVER (PARTITION BY ledger_id, query_id ORDER BY similarity DESC, transaction_id) = 1) n JOIN ag USING (ledger_id, query_id) JOIN mg USING (ledger_id, query_id)
WHERE best >= 0.30 AND source IN ('manual', 'rule', 'imported')"""


def _direct(gated, donors):
    return V.rag_direct(donors, gated.groupBy("ledger_id", "query_id").agg(F.max("best").alias("best")), LOW)


@query(duck(_RAG, **_KNN))
def rag_direct(spark, sf_dir):
    _, gated, donors = _donors(spark, sf_dir)
    return _direct(gated, donors).select("ledger_id", "query_id", "category", "donor_id", "confidence")


@query(duck("""SELECT d.query_id, string_agg(transaction_id, ',' ORDER BY CASE source WHEN 'manual' THEN 0 WHEN 'rule' THEN 1 WHEN 'imported' THEN 2 ELSE 9 END, -similarity, transaction_id) AS examples, any_value(m.category) AS majority, any_value(m.n) AS majority_count
FROM dl d JOIN (SELECT * FROM (SELECT query_id, category, count(*) AS n FROM dl GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, category) = 1) m ON m.query_id = d.query_id GROUP BY d.query_id""", **_KNN))
def fewshot_examples(spark, sf_dir):
    t, near = _knn(spark, sf_dir)
    out = V.fewshot_examples(V.attach_donor_labels(V.novelty_gate(near, LOW), t.rows))
    return out.select("query_id", F.array_join(F.transform("examples", lambda e: e["transaction_id"]), ",").alias("examples"), "majority", "majority_count")


@query(duck("SELECT ledger_id, query_id, category AS majority, n AS agreeing, t AS trusted_agreeing FROM (SELECT ledger_id, query_id, category, count(*) AS n, count(*) FILTER (WHERE source IN ('manual', 'rule', 'imported')) AS t FROM dl WHERE category IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY ledger_id, query_id ORDER BY n DESC, category) = 1", **_KNN))
def neighbour_majority(spark, sf_dir):
    t, near = _knn(spark, sf_dir)
    return V.neighbour_majority(V.attach_donor_labels(V.novelty_gate(near, LOW), t.rows))


# -- scores ---------------------------------------------------------------------------------

_FEED = "SELECT source, category, count(*) FILTER (WHERE feedback = 'confirmed') AS confirmed, count(*) FILTER (WHERE feedback = 'refined') AS refined, count(*) FILTER (WHERE feedback = 'corrected') AS corrected FROM feedback_events WHERE source IN ('llm', 'rag_prompted', 'rag_direct', 'learned_rule', 'rule') GROUP BY ALL"
_DAMP = "SELECT source, category, (5.0 * b + confirmed + 0.5 * refined) / ((5.0 * b + confirmed + 0.5 * refined) + (5.0 * (1.0 - b) + corrected)) AS dampening FROM (SELECT *, CASE source WHEN 'llm' THEN 0.85 ELSE 0.92 END::DOUBLE AS b FROM fc WHERE source IN ('llm', 'rag_prompted'))"


def _dampening(t):
    return V.calibrated_dampening(FB.feedback_counts(t.feedback_events))


@query(duck("SELECT lower(trim(raw_description)) AS description, debit_credit, count(*) AS rows, min(id) AS first_id FROM transactions GROUP BY ALL"))
def distinct_inference_requests(spark, sf_dir):
    return V.distinct_inference_requests(Ledger(spark, sf_dir).transactions)


@query(duck("SELECT source, category, round(dampening, 8) AS dampening FROM dp", fc=_FEED, dp=_DAMP))
def calibrated_dampening(spark, sf_dir):
    return _dampening(Ledger(spark, sf_dir)).withColumn("dampening", F.round("dampening", 8))


_PLAIN = "SELECT p.transaction_id, p.category, CAST(round(CAST(confidence * coalesce(dampening, 0.85) AS DECIMAL(28,10)), 4) AS DOUBLE) AS dampened FROM predictions p LEFT JOIN dp ON dp.source = 'llm' AND dp.category = p.category WHERE stage = 'llm'"


@query(duck(_PLAIN, fc=_FEED, dp=_DAMP))
def score_plain(spark, sf_dir):
    t = Ledger(spark, sf_dir)
    return V.score_plain(t.predictions.where("stage = 'llm'"), _dampening(t)).select("transaction_id", "category", "dampened")


_PROMPT = """SELECT transaction_id, ledger_id, category, CASE WHEN off THEN least(dampened, 0.5) WHEN split THEN least(dampened, 0.5) ELSE dampened END AS scored, CASE WHEN off THEN 'off_example' WHEN split THEN 'defer' END AS cap FROM (
  SELECT p.*, CAST(round(CAST(confidence * coalesce(dampening, 0.92) AS DECIMAL(28,10)), 4) AS DOUBLE) AS dampened, p.category NOT IN ('Food & Dining', 'Transport') AS off, CAST(p.transaction_id AS BIGINT) % 4 = 0 AND confidence < 0.85 AS split
  FROM predictions p LEFT JOIN dp ON dp.source = 'rag_prompted' AND dp.category = p.category WHERE stage = 'rag_prompted')"""


def _prompted(t):
    p = t.predictions.where("stage = 'rag_prompted'").withColumn("example_categories", F.array(F.lit("Food & Dining"), F.lit("Transport")))
    share = F.when(F.col("transaction_id").cast("long") % 4 == 0, 0.5).otherwise(0.8)
    return V.score_prompted(p.withColumn("vote_share", share).withColumn("trusted_weight", F.lit(1.0)), _dampening(t))


@query(duck("SELECT transaction_id, category, scored, cap FROM ps", fc=_FEED, dp=_DAMP, ps=_PROMPT))
def score_prompted(spark, sf_dir):
    return _prompted(Ledger(spark, sf_dir)).select("transaction_id", "category", "scored", "cap")


_FUSED = """SELECT transaction_id, category, CASE WHEN on_ AND pc = category THEN greatest(scored, probability) WHEN on_ THEN least(scored, 0.5) ELSE scored END AS fused,
  CASE WHEN on_ AND pc = category AND probability > scored THEN 'rescue' WHEN on_ AND pc <> category AND scored > 0.5 THEN 'tighten' ELSE 'neutral' END AS effect
  FROM (SELECT ps.*, pr.category AS pc, probability, coalesce(established, false) AS on_ FROM ps LEFT JOIN pr ON pr.id = ps.transaction_id)"""


def _fused(t, prior=None):
    prior = (R.counterparty_prior(t.rows) if prior is None else prior).select(F.col("id").alias("transaction_id"), F.col("category").alias("prior_category"), "probability", "established")
    return V.fuse_prior(_prompted(t).join(prior, "transaction_id", "left"))


@query(duck("SELECT * FROM fu", **_PRIOR, fc=_FEED, dp=_DAMP, ps=_PROMPT, fu=_FUSED))
def fuse_prior(spark, sf_dir):
    return _fused(Ledger(spark, sf_dir)).select("transaction_id", "category", "fused", "effect")


_CASCADE = {
    **_PRIOR, **_KNN, "rd": _RAG, "vr": _VER, "h": _HAY, "mp": _PEOPLE, "kw": _KEYWORD, "lra": _ASOF, "fc": _FEED, "dp": _DAMP, "ps": _PROMPT, "fu": _FUSED, "pl": _PLAIN,
    "st": f"""SELECT id, 1 AS o, 'person' AS stage, category, confidence, source FROM ({_GATE}) UNION ALL SELECT id, 2, 'keyword', category, 0.95::DOUBLE, 'rule' FROM kw WHERE category IS NOT NULL
      UNION ALL SELECT id, 3, 'learned', category, 0.95::DOUBLE, 'learned_rule' FROM lra UNION ALL SELECT query_id, 4, 'rag_direct', category, confidence, 'rag_direct' FROM rd
      UNION ALL SELECT transaction_id, 5, 'prompted', category, fused, 'rag_prompted' FROM fu UNION ALL SELECT transaction_id, 6, 'plain', category, dampened, 'llm' FROM pl""",
    "ca": "SELECT st.id, stage, category, confidence, source FROM st JOIN transactions t ON t.id = st.id QUALIFY row_number() OVER (PARTITION BY st.id ORDER BY o) = 1",
}
_CASCADE["nn"] = _KNN["nn"].replace(" WHERE q.vec_id % 20 = 0", "")  # here every row that is left asks
_CASCADE_CAUSAL = _CASCADE | {"nn": _CAUSAL["nn"].replace(" WHERE q.vec_id % 20 = 0", "")}


def cascade_labels(t: Ledger, causal: bool = False):
    """The cascade over all transactions: rules side by side, then retrieval and answers over what they left."""
    none = F.lit(None).cast("string").alias("subcategory")
    prior = checkpointed(R.counterparty_prior(t.rows))

    def rules(left):
        person = C.person_history_gate(R.match_people(left, t.people), prior)
        keyword = R.match_keyword_rules(left).where("label is not null").select("id", "label.category", "label.subcategory", "label.confidence", "label.source")
        learned = R.learned_rule_asof(t.rows).select("id", "category", none, F.lit(TH.learned_confidence).alias("confidence"), F.lit("learned_rule").alias("source"))
        return C.first_of([("person", person), ("keyword", keyword), ("learned", learned)])

    def retrieved(left):
        return _direct(*_gated(t, _near(t, causal, left))).withColumnRenamed("query_id", "id")

    def prompted(left):
        found = _fused(t, prior).join(left.select(F.col("id").alias("transaction_id")), "transaction_id", "left_semi")
        return found.select(F.col("transaction_id").alias("id"), "category", none, F.col("fused").alias("confidence"), F.lit("rag_prompted").alias("source"))

    def plain(left):
        asked = t.predictions.where("stage = 'llm'").join(left.select(F.col("id").alias("transaction_id")), "transaction_id", "left_semi")
        return V.score_plain(asked, _dampening(t)).select(F.col("transaction_id").alias("id"), "category", none, F.col("dampened").alias("confidence"), F.lit("llm").alias("source"))

    return C.annotate_cascade(t.transactions, [("rules", rules), ("rag_direct", retrieved), ("prompted", prompted), ("plain", plain)], checkpointed)


@query(duck("SELECT * FROM ca", **_CASCADE))
def annotate_cascade(spark, sf_dir):
    return cascade_labels(Ledger(spark, sf_dir)).select("id", "stage", "category", "confidence", "source")


@query(duck("""SELECT t.ledger_id, count(*) FILTER (WHERE k % 9 = 4) AS processed, count(*) FILTER (WHERE k % 9 = 4 AND source = 'rule') AS rule, count(*) FILTER (WHERE k % 9 = 4 AND source = 'learned_rule') AS learned_rule,
count(*) FILTER (WHERE k % 9 = 4 AND source = 'rag_direct') AS rag_direct, count(*) FILTER (WHERE k % 9 = 4 AND source = 'rag_prompted') AS rag_prompted, count(*) FILTER (WHERE k % 9 = 4 AND source = 'llm') AS llm,
count(*) FILTER (WHERE k % 9 = 4 AND source IS NULL) AS failed, count(*) FILTER (WHERE k % 9 = 4 AND confidence < 0.85) AS low_confidence, count(*) FILTER (WHERE k % 9 <> 4) AS already FROM transactions t LEFT JOIN ca ON ca.id = t.id GROUP BY ALL""", **_CASCADE))
def run_counts(spark, sf_dir):
    t = Ledger(spark, sf_dir)
    return C.run_counts(t.transactions, cascade_labels(t), t.annotations.select(F.col("transaction_id").alias("id")))


@query()
def reasoning_trace(spark, sf_dir):
    t = Ledger(spark, sf_dir)
    gated, donors = _gated(t, _near(t, left=t.transactions))
    prior = checkpointed(R.counterparty_prior(t.rows))
    of = lambda df, *cols: df.select(F.col("query_id").alias("id"), *cols)
    best = gated.groupBy(F.col("query_id").alias("id")).agg(F.max("best").alias("best_similarity"))
    facts = t.transactions.select("id", S.embed_text(F.col("debit_credit"), F.col("raw_description"), F.col("note")).alias("embed_text")).join(best, "id", "left")
    for part in (
        of(V.weighted_vote(donors), F.col("vote").alias("vote_category"), "vote_share", "trusted_weight"),
        of(V.agreement_factor(donors), F.round("agreement", 4).alias("agreement_factor")),
        of(V.margin_factor(donors), F.round("margin", 4).alias("margin_factor")),
        prior.select("id", F.col("category").alias("counterparty_prior_category"), F.col("probability").alias("counterparty_prior_probability"), F.col("n_prior").alias("counterparty_prior_n")),
        _fused(t, prior).select(F.col("transaction_id").alias("id"), F.col("effect").alias("counterparty_prior_effect"), F.array_compact(F.array("cap")).alias("caps_applied")),
        t.predictions.select(F.col("transaction_id").alias("id"), F.col("confidence").alias("raw_confidence"), F.concat_ws("/", "stage", "category").alias("calibration_bucket")),
    ):
        facts = facts.join(part, "id", "left")
    return C.reasoning_trace(cascade_labels(t), facts, donors, LOW)


_SHOTS = {
    **_KNN,
    "fs": """SELECT d.query_id, string_agg(concat_ws(' | ', raw_description, concat_ws(' > ', d.category, subcategory), source), chr(10) ORDER BY CASE source WHEN 'manual' THEN 0 WHEN 'rule' THEN 1 WHEN 'imported' THEN 2 ELSE 9 END, -similarity, transaction_id) AS shown, count(*) AS n, any_value(m.category) AS majority, any_value(m.n) AS majority_count
FROM dl d LEFT JOIN (SELECT * FROM (SELECT query_id, category, count(*) AS n FROM dl WHERE category IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, category) = 1) m ON m.query_id = d.query_id GROUP BY d.query_id""",
}


@query(duck(f"""SELECT t.id, concat_ws(chr(10), 'Choose one of: {", ".join(CATEGORIES)}', concat_ws(' ', debit_credit, amount, raw_description), CASE WHEN length(trim(note)) > 0 THEN 'note: ' || trim(note) END,
shown, 'Most similar rows are labelled ' || majority || ' (' || majority_count || ')') AS prompt, shown IS NOT NULL AS with_examples FROM transactions t LEFT JOIN fs ON fs.query_id = t.id""", **_SHOTS))
def render_prompts(spark, sf_dir):
    t, near = _knn(spark, sf_dir)
    shots = V.fewshot_examples(V.attach_donor_labels(V.novelty_gate(near, LOW), t.rows)).withColumnRenamed("query_id", "id").drop("ledger_id")
    return C.render_prompts(t.transactions.join(shots, "id", "left"), CATEGORIES)


_NAMES = {
    "vl": "SELECT DISTINCT CASE WHEN k % 3 = 0 THEN upper(category) WHEN k % 3 = 1 THEN right(category, 9) ELSE category END AS category FROM annotations WHERE category IS NOT NULL",
    "nm": "SELECT unnest([" + ", ".join(f"'{c}'" for c in CATEGORIES) + "]) AS name",
}


def _spelled(t: Ledger):
    return t.annotations.select(F.when(F.col("k") % 3 == 0, F.upper("category")).when(F.col("k") % 3 == 1, F.expr("right(category, 9)")).otherwise(F.col("category")).alias("category"))


@query(duck("""SELECT category, coalesce(e, c, CASE WHEN n = 1 THEN i END) AS normalized, CASE WHEN e IS NOT NULL THEN 'exact' WHEN c IS NOT NULL THEN 'case' ELSE 'inside' END AS how FROM (
  SELECT vl.category, max(name) FILTER (WHERE name = vl.category) AS e, min(name) FILTER (WHERE lower(name) = lower(trim(vl.category))) AS c, max(name) FILTER (WHERE x) AS i, count(*) FILTER (WHERE x) AS n
  FROM (SELECT vl.category, name, contains(lower(name), lower(trim(vl.category))) OR contains(lower(trim(vl.category)), lower(name)) AS x FROM vl, nm) vl GROUP BY 1) WHERE e IS NOT NULL OR c IS NOT NULL OR n = 1""", **_NAMES))
def normalize_category(spark, sf_dir):
    """Here every label is found without the last step."""
    names = spark.createDataFrame([(c,) for c in CATEGORIES], "name string")
    return C.normalize_category(_spelled(Ledger(spark, sf_dir)), names)


_TAX = "SELECT p.name AS category, c.name AS subcategory FROM categories c JOIN categories p ON p.id = c.parent_id"


@query(duck("SELECT DISTINCT a.category, a.subcategory, t.subcategory AS normalized FROM (SELECT DISTINCT category, upper(subcategory) AS subcategory FROM annotations) a LEFT JOIN tax t ON t.category = a.category AND lower(t.subcategory) = lower(a.subcategory)", tax=_TAX))
def normalize_subcategory(spark, sf_dir):
    t = Ledger(spark, sf_dir)
    parent = t.categories.select(F.col("id").alias("parent_id"), F.col("name").alias("category"))
    tax = t.categories.join(parent, "parent_id").select("category", F.col("name").alias("subcategory"))
    return C.normalize_subcategory(t.annotations.select("category", F.upper("subcategory").alias("subcategory")).distinct(), tax)


@query(duck("SELECT c.id, CASE WHEN p.name IS NULL THEN c.name ELSE p.name || ' > ' || c.name END AS path, coalesce(p.name, c.name) AS top FROM categories c LEFT JOIN categories p ON p.id = c.parent_id"))
def category_paths(spark, sf_dir):
    return C.category_paths(Ledger(spark, sf_dir).categories)


@query()
def parse_model_response(spark, sf_dir):
    p = Ledger(spark, sf_dir).predictions
    k = F.col("transaction_id").cast("long")
    body = F.to_json(F.struct("category", "confidence", F.lit("because").alias("reasoning")))
    text = F.when(k % 4 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k % 4 == 1, F.regexp_replace(body, "because", 'a "quoted" word')).when(k % 4 == 2, "sorry").otherwise(body)
    return C.parse_model_response(p.select("transaction_id", text.alias("response")))


@query()
def logprob_confidence(spark, sf_dir):
    p = Ledger(spark, sf_dir).predictions
    parts = [F.struct(F.lit('{"category": "').alias("token"), F.lit(-0.01).alias("logprob")), F.struct(F.col("category").alias("token"), F.log("confidence").alias("logprob")), F.struct(F.lit('"}').alias("token"), F.lit(-0.5).alias("logprob"))]
    return C.logprob_confidence(p.select("transaction_id", "category", F.array(*parts).alias("tokens"))).select("transaction_id", "logprob_confidence")
