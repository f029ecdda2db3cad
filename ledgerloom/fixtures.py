"""The derived ledger: bank tables made from the given order, event and vector tables.

Each table is one SQL text in the words that Spark and DuckDB share, so queries
and their oracles read the same rows.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

CTES: dict[str, str] = {
    "o": """
SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, o_totalprice AS tp, o_orderpriority AS pr,
       CAST(o_custkey % 15 AS INT) AS idx, CAST(floor(o_custkey / 75.0) AS BIGINT) AS ledger_id,
       lpad(CAST(o_orderkey AS STRING), 12, '0') AS id
FROM {orders}""",
    "txn_raw": """
SELECT k, idx, ledger_id, id, pr, d AS txn_date,
       CASE WHEN k % 4 <> 1 THEN CAST((idx + 1) * 99 + ledger_id % 10 AS DECIMAL(18,2)) ELSE CAST(floor(tp) / 100.0 AS DECIMAL(18,2)) END AS amount,
       CASE WHEN idx = 11 OR k % 8 = 0 THEN 'credit' ELSE 'debit' END AS debit_credit,
       CASE idx WHEN 0 THEN 'UPI/SWIGGY/' || id || '/UPI' WHEN 1 THEN 'UPI/ZOMATO/' || id || '/dinner'
         WHEN 2 THEN 'UPI/ZOMATO LIMITED/' || id || '/UPI' WHEN 3 THEN 'UPI/UBER/' || id || '/eats order'
         WHEN 4 THEN 'UPI/UBER/' || id || '/airport ride' WHEN 5 THEN 'AMAZON PRIME VIDEO MUMBAI'
         WHEN 6 THEN 'UPI/GROWW/' || id || '/Monthly SIP' WHEN 7 THEN 'UPI/HOTSTAR/' || id || '/UPI'
         WHEN 8 THEN 'UPI/SANYA  PRASHANT /' || id || '/UPI' WHEN 9 THEN 'UPI/KARABI BORA/' || id || '/UPI'
         WHEN 10 THEN 'UPI/rahul.mehta@ybl/' || id || '/lunch split' WHEN 11 THEN 'NEFT/SAL CREDIT/ACME CORP'
         WHEN 12 THEN 'UPI/CHAI WALA CORNER/' || id || '/chai' WHEN 13 THEN 'UPI/MEDKART/' || id || '/premium tea'
         ELSE 'ATM WITHDRAWAL SBI KORAMANGALA' END AS raw_description,
       CASE idx WHEN 10 THEN 'rahul.mehta@ybl' END AS vpa,
       CASE idx WHEN 1 THEN 'dinner' WHEN 3 THEN 'eats order' WHEN 4 THEN 'airport ride' WHEN 6 THEN 'Monthly SIP'
         WHEN 10 THEN 'lunch split' WHEN 12 THEN 'chai' WHEN 13 THEN 'premium tea' END AS note,
       CASE idx WHEN 0 THEN 'SWIGGY' WHEN 1 THEN 'ZOMATO' WHEN 2 THEN 'ZOMATO LIMITED' WHEN 3 THEN 'UBER' WHEN 4 THEN 'UBER'
         WHEN 6 THEN 'GROWW' WHEN 7 THEN 'HOTSTAR' WHEN 8 THEN 'SANYA PRASHANT' WHEN 9 THEN 'KARABI BORA'
         WHEN 10 THEN 'RAHUL.MEHTA@YBL' WHEN 12 THEN 'CHAI WALA CORNER' WHEN 13 THEN 'MEDKART' END AS counterparty_key,
       row_number() OVER (PARTITION BY ledger_id ORDER BY d, id) AS row_seq
FROM o""",
    "transactions": """
SELECT id, ledger_id, CAST(ledger_id AS STRING) || '-' || substr(CAST(txn_date AS STRING), 1, 7) AS statement_id, txn_date, amount,
       debit_credit, raw_description, vpa, note, counterparty_key, CAST(row_seq AS BIGINT) AS row_seq, k, idx,
       CAST(50000 + sum(CASE WHEN debit_credit = 'credit' THEN amount ELSE -amount END)
         OVER (PARTITION BY ledger_id ORDER BY row_seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(18,2)) AS running_balance
FROM txn_raw""",
    "ann_raw": """
SELECT *, CASE WHEN idx = 11 THEN 'Income' WHEN k % 16 = 0 AND idx NOT IN (8, 9, 10) THEN 'Income'
         WHEN idx IN (8, 9, 10, 14) THEN CASE WHEN k % 17 = 0 THEN 'Entertainment' WHEN k % 19 = 0 THEN 'Self Transfers' ELSE 'Transfers' END
         WHEN idx = 6 THEN 'Investments' WHEN idx = 7 THEN 'Subscriptions' WHEN idx IN (3, 4) THEN 'Transport'
         WHEN idx = 5 THEN 'Entertainment' WHEN idx = 13 THEN 'Health' WHEN k % 13 = 0 THEN 'Miscellaneous' ELSE 'Food & Dining' END AS category
FROM txn_raw WHERE k % 9 <> 4""",
    "annotations": """
SELECT 'a' || id AS id, id AS transaction_id, ledger_id, k,
       CASE WHEN k % 6 = 5 THEN NULL ELSE CASE idx WHEN 0 THEN 'Swiggy' WHEN 1 THEN 'Zomato' WHEN 2 THEN 'Zomato' WHEN 3 THEN 'Uber Eats' WHEN 4 THEN 'Uber'
         WHEN 5 THEN 'Amazon Prime' WHEN 6 THEN 'Groww' WHEN 7 THEN 'Hotstar' WHEN 8 THEN 'sanya' WHEN 10 THEN 'rahul' WHEN 12 THEN 'Chai Wala' WHEN 13 THEN 'Medkart' END END AS merchant,
       category,
       CASE WHEN k % 16 = 0 AND idx NOT IN (8, 9, 10, 11) THEN 'Refund' WHEN idx = 11 THEN CASE WHEN k % 29 = 0 THEN 'Opening Balance' ELSE 'Salary' END
         WHEN idx = 14 THEN 'ATM Withdrawal' WHEN idx < 3 THEN CASE WHEN k % 5 = 0 THEN 'Dining' ELSE 'Restaurants' END END AS subcategory,
       {array}(split_part(category, ' ', 1)) AS tags,
       CASE substr(pr, 1, 1) WHEN '1' THEN 'manual' WHEN '2' THEN 'rule' WHEN '3' THEN 'rag_direct' WHEN '4' THEN 'rag_prompted' ELSE 'llm' END AS source,
       CASE substr(pr, 1, 1) WHEN '1' THEN 1.0e0 WHEN '2' THEN 0.95e0 ELSE CAST(30 + (k * 37) % 70 AS DOUBLE) / 100 END AS confidence,
       txn_date + CAST(k % 5 AS INT) AS annotated_at,
       CASE WHEN substr(pr, 1, 1) = '1' AND k % 3 = 0 THEN 'llm' END AS original_source,
       CASE WHEN substr(pr, 1, 1) IN ('3', '4') THEN CAST(60 + (k * 13) % 40 AS DOUBLE) / 100 END AS best_similarity
FROM ann_raw""",
    "link_raw": """
SELECT k, id, debit_credit, txn_date, max(CASE WHEN debit_credit = 'debit' THEN id END)
         OVER (PARTITION BY ledger_id, idx ORDER BY txn_date, id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS debit_id, ledger_id
FROM transactions""",
    "transaction_links": """
SELECT 'l' || id AS id, ledger_id, least(id, debit_id) AS txn_a, greatest(id, debit_id) AS txn_b, 'refund' AS link_type, txn_date AS created_at
FROM link_raw WHERE debit_credit = 'credit' AND k % 24 = 8 AND debit_id IS NOT NULL""",
    "transaction_group_members": """
SELECT CAST(ledger_id AS STRING) || '-' || substr(CAST(txn_date AS STRING), 1, 4) AS group_id, ledger_id, id AS transaction_id,
       CASE WHEN debit_credit = 'debit' THEN 'event' ELSE 'split' END AS txn_type
FROM transactions WHERE (debit_credit = 'debit' AND k % 20 = 1) OR (debit_credit = 'credit' AND k % 40 = 16)""",
    "ledgers": "SELECT DISTINCT ledger_id FROM txn_raw",
    "people": """
SELECT CAST(ledger_id AS STRING) || 'p1' AS id, ledger_id, 'sanya' AS name, 'sanya' AS upi, 'friend' AS relationship FROM ledgers
UNION ALL SELECT CAST(ledger_id AS STRING) || 'p2', ledger_id, 'ma', 'karabi', 'mom' FROM ledgers
UNION ALL SELECT CAST(ledger_id AS STRING) || 'p3', ledger_id, 'rahul', 'rahul.mehta@ybl', 'friend' FROM ledgers""",
    "stmt_raw": """
SELECT statement_id, ledger_id, substr(CAST(min(txn_date) AS STRING), 1, 7) AS statement_month, min(txn_date) AS period_start, max(txn_date) AS period_end,
       min(row_seq) AS lo, max(row_seq) AS hi
FROM transactions GROUP BY statement_id, ledger_id""",
    "statements": """
SELECT s.statement_id AS id, s.ledger_id, CASE WHEN s.ledger_id % 2 = 0 THEN 'kotak' ELSE 'hdfc' END AS bank_name, statement_month, period_start, period_end,
       CASE WHEN substr(statement_month, 1, 4) <= '1996' AND substr(statement_month, 1, 4) >= '1995' THEN NULL
            WHEN s.ledger_id % 5 = 0 AND CAST(substr(statement_month, 6, 2) AS INT) % 2 = 0 THEN 'ACC' || CAST(s.ledger_id AS STRING) || 'B'
            ELSE 'ACC' || CAST(s.ledger_id AS STRING) END AS account_ref,
       CAST(a.running_balance - CASE WHEN a.debit_credit = 'credit' THEN a.amount ELSE -a.amount END AS DECIMAL(18,2)) AS opening_balance,
       CAST(b.running_balance + CASE WHEN substr(statement_month, 6, 2) = '06' THEN 1 ELSE 0 END AS DECIMAL(18,2)) AS closing_balance
FROM stmt_raw s JOIN transactions a ON a.ledger_id = s.ledger_id AND a.row_seq = s.lo JOIN transactions b ON b.ledger_id = s.ledger_id AND b.row_seq = s.hi""",
    "stmt_no": "SELECT statement_id, ledger_id, lo, hi, CAST(ledger_id * 31 + CAST(substr(statement_month, 1, 4) AS INT) * 12 + CAST(substr(statement_month, 6, 2) AS INT) AS BIGINT) AS n FROM stmt_raw",
    "statement_rows": """
SELECT statement_id AS doc_id, ledger_id, 0 AS table_no, CAST(0 AS BIGINT) AS row_no,
       {array}('Date', 'Narration', CASE WHEN n % 7 = 0 THEN 'Deposit Amt' ELSE 'Withdrawal Amt' END, CASE WHEN n % 7 = 0 THEN 'Withdrawal Amt' ELSE 'Deposit Amt' END, 'Balance') AS cells
FROM stmt_no
UNION ALL
SELECT s.statement_id, s.ledger_id, 0, CASE WHEN n % 3 = 0 THEN s.hi - t.row_seq + 1 ELSE t.row_seq - s.lo + 1 END,
       {array}(CAST(t.txn_date AS STRING), t.raw_description,
         CASE WHEN debit_credit = 'debit' THEN CAST(amount + CASE WHEN n % 11 = 0 AND t.row_seq = s.lo + 1 THEN 7 ELSE 0 END AS STRING) ELSE '' END,
         CASE WHEN debit_credit = 'credit' THEN CAST(amount + CASE WHEN n % 11 = 0 AND t.row_seq = s.lo + 1 THEN 7 ELSE 0 END AS STRING) ELSE '' END,
         CAST(running_balance + 10000000 AS STRING))
FROM stmt_no s JOIN transactions t ON t.statement_id = s.statement_id""",
    "feedback_events": """
SELECT event_id, CASE event_type WHEN 'view' THEN 'confirmed' WHEN 'click' THEN 'confirmed' WHEN 'signup' THEN 'refined' ELSE 'corrected' END AS feedback,
       CASE user_id % 5 WHEN 0 THEN 'llm' WHEN 1 THEN 'rag_prompted' WHEN 2 THEN 'rag_direct' WHEN 3 THEN 'rule' ELSE 'manual' END AS source,
       CASE user_id % 7 WHEN 0 THEN 'Food & Dining' WHEN 1 THEN 'Transport' WHEN 2 THEN 'Transfers' WHEN 3 THEN 'Health' WHEN 4 THEN 'Income' WHEN 5 THEN 'Investments' ELSE 'Entertainment' END AS category
FROM {events}""",
    "categories": """
SELECT 'c:' || category AS id, category AS name, CAST(NULL AS STRING) AS parent_id FROM annotations WHERE category <> 'Miscellaneous' GROUP BY category
UNION ALL SELECT 's:' || category || ':' || subcategory, subcategory, 'c:' || category FROM annotations WHERE subcategory <> 'Opening Balance' AND category <> 'Miscellaneous' GROUP BY category, subcategory""",
    "predictions": """
SELECT t.id AS transaction_id, t.ledger_id, CASE WHEN k % 3 = 0 THEN 'rag_prompted' ELSE 'llm' END AS stage,
       CASE WHEN k % 7 = 0 THEN 'Transfers' WHEN k % 7 = 1 THEN 'Health' WHEN k % 7 < 4 THEN 'Food & Dining' ELSE 'Transport' END AS category,
       CAST(50 + (k * 11) % 50 AS DOUBLE) / 100 AS confidence
FROM transactions t""",
    "vectors": """
SELECT lpad(CAST(e.vec_id AS STRING), 12, '0') AS transaction_id, CAST(e.label AS BIGINT) AS label, e.embedding AS embedding, e.vec_id AS vec_id
FROM {embeddings} e""",
}
SOURCES = ("orders", "events", "embeddings")


#: Derived tables that stand for stored ones; they are checkpointed, so that what reads them twice derives them once.
STORED = ("transactions", "annotations")


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a folder of this machine only in local mode where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file:///tmp/checkpoints/local-{os.getpid()}"
    return root.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut, kept in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()


def spark_table(spark: SparkSession, sf_dir: str, name: str, made: dict[str, DataFrame] | None = None) -> DataFrame:
    """One derived table, built on the tables it names; what it does not need is never read."""
    made = {} if made is None else made
    if name not in made:
        used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in SOURCES if "{" + t + "}" in CTES[name]}
        text = CTES[name].replace("{array}", "array")
        for c in CTES:
            if c != name and re.search(rf"\b(?:FROM|JOIN)\s+{c}\b", text):
                used[c] = spark_table(spark, sf_dir, c, made)
                text = re.sub(rf"\b(FROM|JOIN)\s+{c}\b", rf"\1 {{{c}}}", text)
        made[name] = spark.sql(text, **used)
        if name in STORED:
            made[name] = checkpointed(made[name])
    return made[name]


def _needed(*names: str) -> set[str]:
    found, todo = set(), list(names)
    while todo:
        name = todo.pop()
        if name not in found:
            found.add(name)
            todo += [c for c in CTES if re.search(rf"\b(?:FROM|JOIN)\s+{c}\b", CTES[name])]
    return found


def duck(select: str, **ctes: str) -> str:
    """A DuckDB query over the derived tables, with more common tables in order."""
    text = " ".join([*ctes.values(), select])
    needed = _needed(*[c for c in CTES if re.search(rf"\b(?:FROM|JOIN|,)\s*{c}\b", text)])
    parts = [f"{c} AS ({CTES[c].format(array='list_value', **{t: t for t in SOURCES})})" for c in CTES if c in needed]
    return "WITH " + ", ".join([*parts, *[f"{c} AS ({s})" for c, s in ctes.items()]]) + " " + select
