"""Listing, search and coverage over the derived ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.fixtures import duck
from ledgerloom.operators import listing
from ledgerloom.plans.base import ROWS, Ledger
from ledgerloom.registry import query


@query(duck("SELECT id, ledger_id, txn_date, category, source FROM r WHERE month = '1996-03' AND category IN ('Transport', 'Transfers') AND source IN ('manual', 'llm')", r=ROWS), dates="txn_date")
def list_transactions(spark, sf_dir):
    t = Ledger(spark, sf_dir)
    rows = listing.list_transactions(t.transactions, t.annotations, month="1996-03", categories=["Transport", "Transfers"], sources=["manual", "llm"])
    return rows.select("id", "ledger_id", "txn_date", "category", "source")


@query(duck("SELECT id, raw_description, merchant, note FROM r WHERE contains(lower(raw_description), 'eats') OR contains(lower(merchant), 'eats') OR contains(lower(note), 'eats')", r=ROWS))
def search_transactions(spark, sf_dir):
    t = Ledger(spark, sf_dir)
    return listing.search_transactions(t.transactions, t.annotations, "EATS").select("id", "raw_description", "merchant", "note")


@query(duck("SELECT id, ledger_id FROM transactions WHERE id NOT IN (SELECT transaction_id FROM annotations)"))
def unannotated(spark, sf_dir):
    t = Ledger(spark, sf_dir)
    return listing.unannotated(t.transactions, t.annotations).select("id", "ledger_id")


@query(duck("""SELECT id, ledger_id, txn_date FROM (SELECT t.*, row_number() OVER (PARTITION BY t.ledger_id ORDER BY t.txn_date, t.id) AS n
  FROM transactions t JOIN transactions d ON d.ledger_id = t.ledger_id AND d.row_seq = 100 WHERE t.txn_date > d.txn_date OR (t.txn_date = d.txn_date AND t.id > d.id)) WHERE n <= 25"""), dates="txn_date")
def page_after(spark, sf_dir):
    rows = Ledger(spark, sf_dir).transactions
    cut = rows.where("row_seq = 100").select("ledger_id", F.col("id").alias("_cursor"))
    return listing.page_after(rows.join(cut, "ledger_id"), F.col("_cursor"), 25).select("id", "ledger_id", "txn_date")


@query(duck("SELECT DISTINCT ledger_id, 'category' AS facet, category AS value FROM r WHERE category IS NOT NULL UNION SELECT DISTINCT ledger_id, 'source', source FROM r WHERE source IS NOT NULL", r=ROWS))
def facets(spark, sf_dir):
    return listing.facets(Ledger(spark, sf_dir).rows)


@query(duck("""SELECT ledger_id, 'person' AS kind, id, name FROM people WHERE contains(name, 'ra') OR contains(upi, 'ra')
UNION ALL SELECT ledger_id, 'group', id, name FROM (SELECT ledger_id, group_id AS id, 'Trip ' || group_id AS name, row_number() OVER (PARTITION BY ledger_id ORDER BY group_id) AS n FROM (SELECT DISTINCT ledger_id, group_id FROM transaction_group_members)) WHERE n <= 20 AND contains(lower(name), 'ra')"""))
def search_directory(spark, sf_dir):
    t = Ledger(spark, sf_dir)
    groups = t.transaction_group_members.select("ledger_id", F.col("group_id").alias("id"), F.concat(F.lit("Trip "), "group_id").alias("name")).distinct()
    return listing.search_directory(t.people, groups, "RA")


@query(duck("SELECT DISTINCT counterparty_key AS key, counterparty_key NOT IN ('SWIGGY', 'ZOMATO', 'ZOMATO LIMITED', 'UBER') AS personal FROM transactions WHERE counterparty_key IS NOT NULL"))
def personal_cohort(spark, sf_dir):
    keys = Ledger(spark, sf_dir).transactions.where("counterparty_key is not null").select(F.col("counterparty_key").alias("key")).distinct()
    return keys.select("key", listing.personal_cohort(F.col("key")).alias("personal"))
