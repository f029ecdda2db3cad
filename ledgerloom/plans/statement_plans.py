"""Statement reconstruction over rows rendered from the derived ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.fixtures import checkpointed, duck
from ledgerloom.operators import statements as ST
from ledgerloom.plans.base import Ledger
from ledgerloom.registry import query

#: The entries of each document as printed: its number n, newest first if n % 3 = 0, debit and credit swapped if n % 7 = 0.
_ENTRIES = """SELECT s.statement_id AS doc_id, s.ledger_id, n, CASE WHEN n % 3 = 0 THEN s.hi - t.row_seq + 1 ELSE t.row_seq - s.lo + 1 END AS seq, t.txn_date, t.raw_description AS raw, trim(regexp_replace(t.raw_description, '\\s+', ' ', 'g')) AS description,
  amount + CASE WHEN n % 11 = 0 AND t.row_seq = s.lo + 1 THEN 7 ELSE 0 END AS amount, CASE WHEN n % 7 = 0 THEN CASE debit_credit WHEN 'debit' THEN 'credit' ELSE 'debit' END ELSE debit_credit END AS direction, running_balance + 10000000 AS balance
  FROM stmt_no s JOIN transactions t ON t.statement_id = s.statement_id"""
_CHECK = """SELECT *, abs(balance - lag(balance) OVER w - CASE direction WHEN 'credit' THEN amount ELSE -amount END) <= 0.011 AS ok, lag(txn_date) OVER w <= txn_date AS up FROM {} WINDOW w AS (PARTITION BY doc_id{} ORDER BY seq)"""
_SCORE = "SELECT doc_id, ledger_id{}, coalesce(avg(ok::INT), 0)::DOUBLE AS chain, count(ok) AS checks, coalesce(avg(up::INT), 1)::DOUBLE AS dates FROM {} GROUP BY ALL"
_RESOLVED = {
    "en": _ENTRIES,
    "fo": """SELECT doc_id, ledger_id, v AS variant, CASE WHEN v >= 2 THEN max(seq) OVER (PARTITION BY doc_id) + 1 - seq ELSE seq END AS seq, txn_date, raw, description, amount, CASE WHEN v % 2 = 1 THEN CASE direction WHEN 'debit' THEN 'credit' ELSE 'debit' END ELSE direction END AS direction, balance
      FROM en, (SELECT unnest([0, 1, 2, 3]) AS v)""",
    "fk": _CHECK.format("fo", ", variant"),
    "fs": _SCORE.format(", variant", "fk"),
    "be": "SELECT doc_id, ledger_id, variant, chain, checks FROM fs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY chain DESC, dates DESC, variant) = 1",
    "re": "SELECT fo.*, chain AS verified, checks FROM fo JOIN be ON be.doc_id = fo.doc_id AND be.variant = fo.variant",
}


def _carried(t):
    return ST.carry_header(t.statement_rows)


def _entries(t):
    # the parsed cells are stored: what follows reads each several times
    return ST.merge_continuations(checkpointed(ST.classify_rows(_carried(t))))


def _resolved(t):
    return ST.resolve_variant(_entries(t))


@query(duck("SELECT statement_id AS doc_id, 0 AS date, 1 AS description, CASE WHEN n % 7 = 0 THEN 3 ELSE 2 END AS debit, CASE WHEN n % 7 = 0 THEN 2 ELSE 3 END AS credit, 4 AS balance FROM stmt_no"))
def map_header(spark, sf_dir):
    rows = Ledger(spark, sf_dir).statement_rows
    return rows.select("doc_id", ST.map_header(F.col("cells")).alias("m")).where("m is not null").select("doc_id", "m.date", "m.description", "m.debit", "m.credit", "m.balance")


@query(duck("SELECT doc_id, seq AS row_no, CASE WHEN n % 7 = 0 THEN 3 ELSE 2 END AS debit_column FROM en", en=_ENTRIES))
def carry_header(spark, sf_dir):
    return _carried(Ledger(spark, sf_dir)).select("doc_id", "row_no", F.col("map.debit").alias("debit_column"))


@query(duck("SELECT doc_id, seq AS row_no, 'entry' AS kind, txn_date, CAST(amount AS DOUBLE) AS amount, direction, CAST(balance AS DOUBLE) AS balance FROM en", en=_ENTRIES), dates="txn_date")
def classify_rows(spark, sf_dir):
    out = ST.classify_rows(_carried(Ledger(spark, sf_dir)))
    return out.select("doc_id", "row_no", "kind", "txn_date", F.col("amount").cast("double").alias("amount"), "direction", F.col("balance").cast("double").alias("balance"))


@query(duck("SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS BIGINT) AS seq, description || CASE WHEN seq % 4 = 1 THEN ' carried on' ELSE '' END AS description FROM en", en=_ENTRIES))
def merge_continuations(spark, sf_dir):
    rows = checkpointed(ST.classify_rows(_carried(Ledger(spark, sf_dir))))
    more = rows.where("row_no % 4 = 1").select("doc_id", "ledger_id", "table_no", (F.col("row_no") + 0.5).alias("row_no"), F.lit("more").alias("kind"), F.lit("carried on").alias("description"))
    both = rows.withColumn("row_no", F.col("row_no").cast("double")).unionByName(more.withColumn("row_no", F.col("row_no").cast("double")), allowMissingColumns=True)
    return ST.merge_continuations(both).select("doc_id", "seq", "description")


@query(duck("SELECT doc_id, seq, CASE WHEN seq % 2 = 1 THEN direction WHEN balance >= lag(balance) OVER (PARTITION BY doc_id ORDER BY seq) THEN 'credit' WHEN lag(balance) OVER (PARTITION BY doc_id ORDER BY seq) IS NOT NULL THEN 'debit' END AS direction FROM en", en=_ENTRIES))
def infer_direction(spark, sf_dir):
    unknown = _entries(Ledger(spark, sf_dir)).withColumn("direction", F.when(F.col("seq") % 2 == 1, F.col("direction")))
    return ST.infer_direction(unknown).select("doc_id", "seq", "direction")


@query(duck("SELECT doc_id, round(chain, 6) AS chain, checks FROM sc", en=_ENTRIES, ck=_CHECK.format("en", ""), sc=_SCORE.format("", "ck")))
def chain_score(spark, sf_dir):
    return ST.chain_score(_entries(Ledger(spark, sf_dir))).select("doc_id", F.round("chain", 6).alias("chain"), "checks")


@query(duck("SELECT doc_id, round(dates, 6) AS dates FROM sc", en=_ENTRIES, ck=_CHECK.format("en", ""), sc=_SCORE.format("", "ck")))
def date_order_score(spark, sf_dir):
    return ST.date_order_score(_entries(Ledger(spark, sf_dir))).withColumn("dates", F.round("dates", 6))


@query(duck("SELECT doc_id, variant, seq, CAST(amount AS DOUBLE) AS amount, direction, round(verified, 6) AS verified FROM re", **_RESOLVED))
def resolve_variant(spark, sf_dir):
    return _resolved(Ledger(spark, sf_dir)).select("doc_id", "variant", "seq", F.col("amount").cast("double").alias("amount"), "direction", F.round("verified", 6).alias("verified"))


@query(duck("SELECT doc_id, count(*) AS transactions, max(checks) AS checks, count(*) >= 3 AND max(checks) > 0 AND max(verified) >= 0.8 AS accepted FROM re GROUP BY ALL", **_RESOLVED))
def confidence_gate(spark, sf_dir):
    return ST.confidence_gate(_resolved(Ledger(spark, sf_dir))).select("doc_id", "transactions", "checks", "accepted")


def _six(t: Ledger):
    """Statements of every other ledger as a bank with the dedicated layout prints them."""
    text = lambda d: F.when(F.col("debit_credit") == d, F.concat(F.lit("-" if d == "debit" else "+"), F.format_number("amount", 2))).otherwise("")
    cells = F.array(F.date_format("txn_date", "d MMM, yyyy"), "raw_description", F.lit("ref"), text("debit"), text("credit"), F.format_number("running_balance", 2))
    return t.transactions.where("ledger_id % 2 = 0").select(F.col("statement_id").alias("doc_id"), "ledger_id", F.lit(0).alias("table_no"), F.col("row_seq").alias("row_no"), cells.alias("cells"))


@query(duck("SELECT statement_id AS doc_id, row_seq AS row_no, txn_date, CAST(amount AS DOUBLE) AS amount, debit_credit, CAST(running_balance AS DOUBLE) AS balance FROM transactions WHERE ledger_id % 2 = 0"), dates="txn_date")
def fixed_layout_rows(spark, sf_dir):
    return ST.fixed_layout_rows(_six(Ledger(spark, sf_dir))).select("doc_id", "row_no", "txn_date", F.col("amount").cast("double").alias("amount"), "debit_credit", F.col("running_balance").cast("double").alias("balance"))


@query(duck("""SELECT statement_id AS doc_id, 'six columns' AS layout, row_number() OVER (PARTITION BY statement_id ORDER BY row_seq) AS seq, txn_date, CAST(amount AS DOUBLE) AS amount, debit_credit AS direction, CAST(running_balance AS DOUBLE) AS balance FROM transactions WHERE ledger_id % 2 = 0
UNION ALL SELECT doc_id, 'header', row_number() OVER (PARTITION BY doc_id ORDER BY seq), txn_date, CAST(amount AS DOUBLE), direction, CAST(balance AS DOUBLE) FROM en WHERE ledger_id % 2 = 1""", en=_ENTRIES), dates="txn_date")
def read_layouts(spark, sf_dir):
    """Statements of two layouts, both read from the tables of layouts and words."""
    t = Ledger(spark, sf_dir)
    rows = t.statement_rows.where("ledger_id % 2 = 1").unionByName(_six(t))
    found = ST.read_layouts(rows, keep=checkpointed)
    return found.select("doc_id", "layout", F.col("seq").cast("long").alias("seq"), "txn_date", F.col("amount").cast("double").alias("amount"), "direction", F.col("balance").cast("double").alias("balance"))


_PARSED = {
    "en": _ENTRIES,
    "fw": "SELECT doc_id, count(*) FILTER (WHERE ok) AS f FROM (SELECT doc_id, abs(balance - lag(balance) OVER w - CASE direction WHEN 'credit' THEN amount ELSE -amount END) <= 0.011 AS ok FROM en WINDOW w AS (PARTITION BY doc_id ORDER BY seq)) GROUP BY 1",
    "bw": "SELECT doc_id, count(*) FILTER (WHERE ok) AS b FROM (SELECT doc_id, abs(balance - lag(balance) OVER w - CASE direction WHEN 'credit' THEN amount ELSE -amount END) <= 0.011 AS ok FROM en WINDOW w AS (PARTITION BY doc_id ORDER BY seq DESC)) GROUP BY 1",
    "ed": "SELECT doc_id, arg_min(txn_date, seq) AS a, arg_max(txn_date, seq) AS z, max(seq) AS m FROM en GROUP BY 1",
    "co": "SELECT en.*, CASE WHEN a > z OR (a = z AND b > f) THEN m + 1 - seq ELSE seq END AS place FROM en JOIN ed USING (doc_id) JOIN fw USING (doc_id) JOIN bw USING (doc_id)",
}


@query(duck("SELECT doc_id, description, place AS seq, CAST(amount AS DOUBLE) AS amount FROM co", **_PARSED))
def chain_order(spark, sf_dir):
    return ST.chain_order(_entries(Ledger(spark, sf_dir))).select("doc_id", "description", "seq", F.col("amount").cast("double").alias("amount"))


@query(duck("""SELECT doc_id, CAST(arg_min(balance + CASE direction WHEN 'debit' THEN amount ELSE -amount END, place) AS DOUBLE) AS opening, CAST(CASE WHEN any_value(n) % 2 = 0 THEN 1.5 ELSE arg_max(balance, place) END AS DOUBLE) AS closing, count(*) AS transactions FROM co GROUP BY doc_id""", **_PARSED))
def split_balance_artifacts(spark, sf_dir):
    t = Ledger(spark, sf_dir)
    ordered = ST.chain_order(_entries(t)).withColumnRenamed("description", "raw_description")
    even = t.stmt_no.where("n % 2 = 0").select(F.col("statement_id").alias("doc_id"), F.lit(10**6).cast("long").alias("seq"), F.lit("Closing Balance").alias("raw_description"), F.lit(1.5).cast("decimal(18,2)").alias("balance"))
    out = ST.split_balance_artifacts(ordered.unionByName(even, allowMissingColumns=True))
    return out.select("doc_id", F.col("opening_balance").cast("double").alias("opening"), F.col("closing_balance").cast("double").alias("closing"), "transactions")


@query(duck("SELECT statement_id, min(txn_date) AS period_start, max(txn_date) AS period_end, strftime(min(txn_date), '%Y-%m') AS statement_month FROM transactions GROUP BY 1"), dates="period_start period_end")
def statement_periods(spark, sf_dir):
    return ST.statement_periods(Ledger(spark, sf_dir).transactions)


@query(duck("""SELECT ledger_id, id, 'opening' AS kind, p AS neighbour, CAST(opening_balance AS DOUBLE) AS own, CAST(pc AS DOUBLE) AS other FROM (SELECT s.*, x.id AS p, x.closing_balance AS pc, row_number() OVER (PARTITION BY s.id ORDER BY x.period_end DESC) AS n
  FROM statements s JOIN statements x ON x.ledger_id = s.ledger_id AND x.bank_name = s.bank_name AND x.account_ref IS NOT DISTINCT FROM s.account_ref AND x.period_end < s.period_start) WHERE n = 1 AND abs(opening_balance - pc) > 0.01
UNION ALL SELECT ledger_id, id, 'closing', p, CAST(closing_balance AS DOUBLE), CAST(po AS DOUBLE) FROM (SELECT s.*, x.id AS p, x.opening_balance AS po, row_number() OVER (PARTITION BY s.id ORDER BY x.period_start) AS n
  FROM statements s JOIN statements x ON x.ledger_id = s.ledger_id AND x.bank_name = s.bank_name AND x.account_ref IS NOT DISTINCT FROM s.account_ref AND x.period_start > s.period_end) WHERE n = 1 AND abs(closing_balance - po) > 0.01"""))
def continuity_warnings(spark, sf_dir):
    return ST.continuity_warnings(Ledger(spark, sf_dir).statements)
