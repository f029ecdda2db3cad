"""Sources, sinks and streams over the derived ledger."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerloom.fixtures import checkpointed, duck, shared_root
from ledgerloom.operators import evaluate as E
from ledgerloom.operators import rules as R
from ledgerloom.plans import label_plans as L
from ledgerloom.plans.base import ROWS, Ledger
from ledgerloom.plans.merge_plans import _REC, _records
from ledgerloom.plans.scalar_plans import _STRIP
from ledgerloom.registry import query
from ledgerloom.sources import merges as M
from ledgerloom.sources import tables as T
from ledgerloom.streaming import jobs as J


def _folder(spark) -> str:
    """A new folder in the shared folder."""
    return f"{shared_root(spark)}/ledger-{uuid.uuid4().hex}"


@query(duck("SELECT doc_id, ledger_id, row_no, array_to_string(cells, '|') AS cells FROM statement_rows"))
def read_statement_rows(spark, sf_dir):
    path = f"{_folder(spark)}/rows"
    Ledger(spark, sf_dir).statement_rows.write.parquet(path)
    return T.read_statement_rows(spark, path).select("doc_id", "ledger_id", "row_no", F.array_join("cells", "|").alias("cells"))


_FILES = "SELECT statement_id AS path, sha256(CAST(ledger_id AS STRING) || '/' || CAST(hi % 3 AS STRING)) AS file_sha256, ledger_id FROM stmt_raw"


@query(duck("SELECT min(path) AS path, file_sha256 FROM f WHERE file_sha256 NOT IN (SELECT file_sha256 FROM f WHERE ledger_id % 5 = 2) GROUP BY file_sha256", f=_FILES))
def dedup_statement_files(spark, sf_dir):
    files = Ledger(spark, sf_dir).stmt_raw.select(F.col("statement_id").alias("path"), "ledger_id", F.concat_ws("/", F.col("ledger_id").cast("string"), (F.col("hi") % 3).cast("string")).cast("binary").alias("content"))
    known = files.where("ledger_id % 5 = 2").select(F.sha2("content", 256).alias("file_sha256"))
    return T.dedup_statement_files(files.select("path", "content"), known).select("path", "file_sha256")


@query(duck("SELECT id, counterparty_key, substr(CAST(txn_date AS STRING), 1, 7) AS month FROM transactions WHERE k % 3 <> 0"))
def append_ledger(spark, sf_dir):
    t = Ledger(spark, sf_dir).transactions
    return T.append_ledger(t.where("k % 3 = 0"), t.drop("counterparty_key")).select("id", "counterparty_key", "month")


@query(duck("""SELECT 'statement' AS part, statement_month AS month, count(*) AS rows, 0::BIGINT AS keyed FROM statements GROUP BY ALL
UNION ALL SELECT 'transaction', substr(CAST(txn_date AS STRING), 1, 7), count(*), count(counterparty_key) FROM transactions GROUP BY ALL"""))
def append_statements(spark, sf_dir):
    """Half of the ledgers, then all of them, of which half are there."""
    t, root = Ledger(spark, sf_dir), f"{_folder(spark)}/tables"
    rows = t.transactions.drop("counterparty_key")
    for some in ("ledger_id % 2 = 0", "true"):
        M.append_statements(root, t.statements.where(some), rows.where(some), checkpointed)
    statements, transactions = (spark.read.parquet(f"{root}/{x}") for x in ("statements", "transactions"))
    one = statements.groupBy(F.col("statement_month").alias("month")).agg(F.count("*").alias("rows")).select(F.lit("statement").alias("part"), F.col("month").cast("string").alias("month"), "rows", F.lit(0).cast("long").alias("keyed"))
    two = transactions.groupBy("month").agg(F.count("*").alias("rows"), F.count("counterparty_key").alias("keyed"))
    return one.unionByName(two.select(F.lit("transaction").alias("part"), F.col("month").cast("string").alias("month"), "rows", "keyed"))


@query(duck("SELECT transaction_id, CASE WHEN k % 4 = 0 AND ledger_id % 3 = 0 THEN 'Health' ELSE category END AS category FROM annotations"))
def upsert_labels(spark, sf_dir):
    """Labels of a third of the ledgers into a table of all; old ones come too late."""
    a, path = Ledger(spark, sf_dir).annotations, f"{_folder(spark)}/labels"
    M.upsert_labels(path, a, checkpointed)
    new = a.where("ledger_id % 3 = 0 and k % 4 = 0").withColumn("category", F.lit("Health"))
    late = a.where("ledger_id % 3 = 0 and k % 4 = 1").withColumn("category", F.lit("Old")).withColumn("annotated_at", F.lit("1990-01-01").cast(a.schema["annotated_at"].dataType))
    M.upsert_labels(path, new.union(late), checkpointed)
    return spark.read.parquet(path).select("transaction_id", "category")


@query(duck("SELECT transaction_id, CASE WHEN k % 4 = 0 THEN 'Health' ELSE category END AS category FROM annotations"))
def upsert_annotations(spark, sf_dir):
    a = Ledger(spark, sf_dir).annotations
    new = a.where("k % 4 = 0").withColumn("category", F.lit("Health")).union(a.where("k % 4 = 1").withColumn("category", F.lit("Old")).withColumn("annotated_at", F.lit("1990-01-01").cast("date")))
    return T.upsert_annotations(a, new).select("transaction_id", "category")


@query(duck("SELECT transaction_id, CASE WHEN vec_id % 2 = 0 THEN 'm2' ELSE 'm1' END AS model_version FROM vectors"))
def upsert_embeddings(spark, sf_dir):
    v = Ledger(spark, sf_dir).vectors
    old = v.select("transaction_id", "embedding", F.lit("m1").alias("model_version"), F.lit("2024-01-01").cast("timestamp").alias("created_at"))
    new = v.where("vec_id % 2 = 0").select("transaction_id", "embedding", F.lit("m2").alias("model_version"), F.lit("2024-02-01").cast("timestamp").alias("created_at"))
    return T.upsert_embeddings(old, new).select("transaction_id", "model_version")


@query(duck("SELECT id AS transaction_id, ledger_id, txn_date, category, subcategory, merchant, original_source FROM r WHERE source = 'manual'", r=ROWS), dates="txn_date")
def export_golden(spark, sf_dir):
    path = f"{_folder(spark)}/golden"
    T.export_golden(Ledger(spark, sf_dir).rows, path)
    return T.read_golden(spark, path)


@query(duck("SELECT transaction_id, category, correct FROM rec WHERE NOT correct", r=ROWS, rec=_REC))
def write_eval_run(spark, sf_dir):
    path, records = f"{_folder(spark)}/run", _records(Ledger(spark, sf_dir))
    T.write_eval_run(records, E.eval_metrics(records), path)
    return spark.read.schema("transaction_id string, category string, correct boolean").json(f"{path}/failures")


@query(duck(f"SELECT id AS transaction_id, 'm1' AS model_version, CAST(length(lower(trim(concat_ws(' ', debit_credit, nullif({_STRIP}, ''), nullif(note, ''))))) AS DOUBLE) AS length FROM r WHERE annotation_id IS NOT NULL AND id NOT IN (SELECT transaction_id FROM vectors)", r=ROWS))
def embed_pending(spark, sf_dir):
    t = Ledger(spark, sf_dir)
    have = t.vectors.select("transaction_id", F.lit("m1").alias("model_version"))
    made = T.embed_pending(t.rows, have, "m1", lambda texts: [[float(len(x)), float(x.count("/"))] for x in texts])
    return made.where("error is null").select("transaction_id", "model_version", F.get("embedding", F.lit(0)).cast("double").alias("length"))


def _source(spark, df, folder):
    """Write a table as files and read these as a stream."""
    df.repartition(4).write.parquet(f"{folder}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")


@query(duck("""SELECT t.id, CASE WHEN mp.id IS NOT NULL THEN 'person' WHEN kw.category IS NOT NULL THEN 'keyword' ELSE 'learned' END AS stage, CASE WHEN mp.id IS NOT NULL THEN 'Transfers' ELSE coalesce(kw.category, lr.category) END AS category
FROM transactions t LEFT JOIN mp ON mp.id = t.id LEFT JOIN kw ON kw.id = t.id LEFT JOIN lr ON lr.ledger_id = t.ledger_id AND lr.counterparty_key = t.counterparty_key WHERE coalesce(mp.id, kw.category, lr.category) IS NOT NULL""", **L._LEARNED, h=L._HAY, kw=L._KEYWORD, mp=L._PEOPLE))
def stream_annotate(spark, sf_dir):
    folder, t = _folder(spark), Ledger(spark, sf_dir)
    at = lambda day: F.lit(day).cast("timestamp").alias("uploaded_at")
    rows = t.transactions.select("id", "ledger_id", F.sha2("statement_id", 256).alias("file_sha256"), "raw_description", "vpa", "note", "counterparty_key")
    again = rows.where("substring(id, 12, 1) = '3'")
    stream = _source(spark, rows.select("*", at("2024-01-01")).union(again.select("*", at("2024-01-02"))), folder)
    J.stream_annotate(stream, f"{folder}/out", f"{folder}/state", t.people, R.learned_rules(t.rows))
    return spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out").select("id", "stage", "category")


@query(duck("SELECT * FROM fc", fc=L._FEED))
def stream_feedback(spark, sf_dir):
    folder = _folder(spark)
    J.stream_feedback(_source(spark, Ledger(spark, sf_dir).feedback_events, folder), f"{folder}/out", f"{folder}/state")
    return J.latest(spark, f"{folder}/out", ["source", "category"])


@query(duck("SELECT ledger_id, substr(CAST(txn_date AS STRING), 1, 7) AS month, round(CAST(coalesce(sum(amount) FILTER (WHERE debit_credit = 'credit'), 0) AS DOUBLE), 2) AS money_in, round(CAST(coalesce(sum(amount) FILTER (WHERE debit_credit = 'debit'), 0) AS DOUBLE), 2) AS money_out, count(*) AS rows FROM transactions GROUP BY ALL"))
def stream_monthly_cash(spark, sf_dir):
    folder = _folder(spark)
    rows = Ledger(spark, sf_dir).transactions.select("ledger_id", F.col("txn_date").cast("timestamp").alias("at"), "debit_credit", "amount")
    # rows arrive in no order, so that many are late; these are summed in batch
    J.stream_monthly_cash(_source(spark, rows, folder), f"{folder}/out", f"{folder}/state", 300)
    return J.monthly(J.daily_cash(spark, f"{folder}/out"))
