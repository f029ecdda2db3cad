"""Scalar functions over the derived ledger's descriptions, dates and amounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.fixtures import duck
from ledgerloom.functions import scalars as S
from ledgerloom.plans.base import Ledger
from ledgerloom.registry import query

UPI = "upper(trim(split_part(raw_description, '/', 1))) = 'UPI'"


@query(duck(f"SELECT id, CASE WHEN {UPI} THEN nullif(upper(trim(regexp_replace(split_part(raw_description, '/', 2), '\\s+', ' ', 'g'))), '') END AS counterparty_key FROM transactions"))
def counterparty_key(spark, sf_dir):
    return Ledger(spark, sf_dir).transactions.select("id", S.counterparty_key(F.col("raw_description")).alias("counterparty_key"))


@query(duck(
    """SELECT id, upi, list_filter(seg, lambda x: regexp_matches(x, '^[\\w.\\-]{2,}@[A-Za-z]\\w*$'))[1] AS vpa, list_filter(seg, lambda x: regexp_matches(x, '^\\d{6,}$'))[1] AS ref,
    CASE WHEN len(seg) >= 2 AND upper(seg[-1]) NOT IN ('UPI', 'NEFT', 'IMPS', 'RTGS', 'NA', 'NO REMARKS', 'N/A', 'NONE', '-') AND NOT regexp_matches(seg[-1], '^\\d{6,}$')
      AND seg[-1] IS DISTINCT FROM list_filter(seg, lambda x: regexp_matches(x, '^[\\w.\\-]{2,}@[A-Za-z]\\w*$'))[1] THEN seg[-1] END AS note FROM s WHERE upi""",
    s="SELECT id, upper(p[1]) = 'UPI' AS upi, p[2:] AS seg FROM (SELECT id, list_filter(list_transform(string_split(raw_description, '/'), lambda x: trim(x)), lambda x: x <> '') AS p FROM transactions)",
))
def parse_upi(spark, sf_dir):
    rows = Ledger(spark, sf_dir).transactions.select("id", S.parse_upi(F.col("raw_description")).alias("u")).where("u is not null")
    return rows.select("id", F.lit(True).alias("upi"), "u.vpa", "u.ref", "u.note")


_STRIP = """CASE WHEN regexp_matches(trim(raw_description), '(?i)^UPI/[^/]+/\\d{4,}/[^\\n]*$') THEN
  regexp_extract(trim(raw_description), '(?i)^(UPI/[^/]+)/', 1) || CASE WHEN upper(trim(regexp_extract(trim(raw_description), '(?i)^UPI/[^/]+/\\d{4,}/(.*)$', 1))) IN ('', 'UPI') THEN ''
  ELSE '/' || trim(regexp_extract(trim(raw_description), '(?i)^UPI/[^/]+/\\d{4,}/(.*)$', 1)) END ELSE raw_description END"""


@query(duck(f"SELECT id, {_STRIP} AS stripped FROM transactions"))
def strip_upi_ref(spark, sf_dir):
    return Ledger(spark, sf_dir).transactions.select("id", S.strip_upi_ref(F.col("raw_description")).alias("stripped"))


@query(duck(f"SELECT id, lower(trim(concat_ws(' ', debit_credit, nullif({_STRIP}, ''), nullif(note, '')))) AS embed_text FROM transactions"))
def embed_text(spark, sf_dir):
    return Ledger(spark, sf_dir).transactions.select("id", S.embed_text(F.col("debit_credit"), F.col("raw_description"), F.col("note")).alias("embed_text"))


@query(duck("SELECT id, CASE WHEN k % 2 = 0 THEN '[\"' || split_part(category, ' ', 1) || '\", \"x\"]' ELSE split_part(category, ' ', 1) || ',,x' END AS raw, split_part(category, ' ', 1) || '+x' AS items FROM (SELECT transaction_id AS id, k, category FROM annotations)"))
def parse_string_list(spark, sf_dir):
    first = F.split_part("category", F.lit(" "), F.lit(1))
    raw = F.when(F.col("k") % 2 == 0, F.concat(F.lit('["'), first, F.lit('", "x"]'))).otherwise(F.concat(first, F.lit(",,x")))
    rows = Ledger(spark, sf_dir).annotations.select(F.col("transaction_id").alias("id"), raw.alias("raw"))
    return rows.select("id", "raw", F.array_join(S.parse_string_list(F.col("raw")), "+").alias("items"))


@query(duck("SELECT id, CAST(amount AS DOUBLE) AS value, CASE WHEN k % 3 = 0 THEN CASE debit_credit WHEN 'credit' THEN 'credit' ELSE 'debit' END END AS direction FROM transactions WHERE k % 10 <> 7 UNION ALL SELECT id, NULL, NULL FROM transactions WHERE k % 10 = 7"))
def parse_amount(spark, sf_dir):
    mark = F.when(F.col("k") % 3 == 0, F.when(F.col("debit_credit") == "credit", " Cr").otherwise(" Dr.")).otherwise("")
    cell = F.when(F.col("k") % 10 == 7, "n/a").otherwise(F.concat(F.lit("₹ "), F.format_number("amount", 2), mark))
    rows = Ledger(spark, sf_dir).transactions.select("id", S.parse_amount(cell).alias("a"))
    return rows.select("id", F.col("a.value").cast("double").alias("value"), "a.direction")


@query(duck("SELECT id, CASE WHEN k % 6 = 5 THEN NULL ELSE txn_date END AS day FROM transactions"), dates="day")
def parse_statement_date(spark, sf_dir):
    rows = Ledger(spark, sf_dir).transactions
    d = F.col("txn_date")
    cell = F.when(F.col("k") % 6 == 0, F.date_format(d, "dd/MM/yyyy")).when(F.col("k") % 6 == 1, F.date_format(d, "d-M-yyyy")).when(F.col("k") % 6 == 2, F.date_format(d, "d MMM, yyyy"))
    cell = cell.when(F.col("k") % 6 == 3, F.date_format(d, "yyyy-MM-dd")).when(F.col("k") % 6 == 4, F.upper(F.date_format(d, "dd-MMM-yyyy"))).otherwise("n/a")
    return rows.select("id", S.parse_statement_date(cell).alias("day"))


@query(duck("SELECT id, CASE k % 4 WHEN 0 THEN 'opening' WHEN 1 THEN 'closing' END AS kind FROM transactions"))
def is_balance_artifact(spark, sf_dir):
    text = F.when(F.col("k") % 4 == 0, "Opening  Balance").when(F.col("k") % 4 == 1, "balance c/f x").when(F.col("k") % 4 == 2, "Int.Pd Closing Balance").otherwise(F.col("raw_description"))
    return Ledger(spark, sf_dir).transactions.select("id", S.balance_artifact(text).alias("kind"))


@query(duck("SELECT id, upper(account_ref) || '-001' AS ref FROM statements WHERE account_ref IS NULL UNION ALL SELECT id, 'XXXX' || lpad(CAST(ledger_id AS STRING), 6, '0') FROM statements WHERE account_ref IS NOT NULL"))
def account_ref(spark, sf_dir):
    number = F.lpad(F.col("ledger_id").cast("string"), 6, "0")
    header = F.when(F.col("account_ref").isNull(), "Statement of ACCOUNT").otherwise(F.concat(F.lit("Customer A/c No. : xxxx"), number))
    return Ledger(spark, sf_dir).statements.select("id", S.account_ref(header).alias("ref"))


@query(duck("SELECT id, CASE WHEN bank_name = 'kotak' THEN 'kotak' WHEN ledger_id % 3 = 0 THEN 'generic' ELSE 'hdfc (auto)' END AS label FROM statements"))
def bank_label(spark, sf_dir):
    header = F.when(F.col("bank_name") == "kotak", "KOTAK Mahindra").when(F.col("ledger_id") % 3 == 0, "Co-op").otherwise("HDFC Bank, not Axis")
    return Ledger(spark, sf_dir).statements.select("id", S.bank_label(header).alias("label"))


@query(duck("SELECT id, CASE WHEN relationship = 'mom' THEN 'Family' ELSE 'Peer Transfer' END AS subcategory FROM people"))
def relationship_subcategory(spark, sf_dir):
    return Ledger(spark, sf_dir).people.select("id", S.relationship_subcategory(F.concat(F.lit(" "), F.upper("relationship"))).alias("subcategory"))


@query(duck("SELECT id, CASE subcategory WHEN 'Dining' THEN 'Restaurants' ELSE coalesce(subcategory, 'Other') END AS sub FROM annotations"))
def canonical_subcategory(spark, sf_dir):
    return Ledger(spark, sf_dir).annotations.select("id", S.canonical_subcategory(F.col("subcategory")).alias("sub"))


@query(duck("SELECT id, coalesce(category, 'Uncategorized') NOT IN ('Self Transfers', 'Investments', 'Transfers', 'Income') AS spend FROM annotations"))
def is_spend(spark, sf_dir):
    return Ledger(spark, sf_dir).annotations.select("id", S.is_spend(F.col("category")).alias("spend"))


@query(duck("SELECT id, strftime(txn_date, '%Y-%m') AS month, strftime(date_trunc('month', txn_date) - INTERVAL 1 DAY, '%Y-%m') AS prev, CAST(year(txn_date) * 12 + month(txn_date) AS INT) AS idx FROM transactions"))
def month_of(spark, sf_dir):
    month = S.month_of(F.col("txn_date"))
    return Ledger(spark, sf_dir).transactions.select("id", month.alias("month"), S.prev_month(month).alias("prev"), S.month_index(month).alias("idx"))


@query(duck("""SELECT id, CASE WHEN k % 3 = 0 THEN 'confirmed' WHEN k % 3 = 1 AND category <> 'Health' THEN 'corrected' WHEN k % 3 = 2 THEN CASE WHEN subcategory IS NULL THEN 'confirmed' ELSE 'refined' END ELSE 'confirmed' END AS feedback FROM annotations"""))
def classify_feedback(spark, sf_dir):
    anns, k = Ledger(spark, sf_dir).annotations, F.col("k") % 3
    none = F.lit(None).cast("string")
    sent = {"category": k == 1, "subcategory": k == 2}
    new = {"category": F.when(k == 1, "Health"), "subcategory": none}
    return anns.select("id", S.classify_feedback({"category": F.col("category"), "subcategory": F.col("subcategory")}, new, sent).alias("feedback"))
