"""Listing, searching and paging of a ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S


def labelled(txns: DataFrame, anns: DataFrame, how: str = "left") -> DataFrame:
    """Transactions with their label, one row a transaction."""
    label = anns.select(
        F.col("transaction_id").alias("id"), F.col("id").alias("annotation_id"), "merchant", "category", "subcategory", "tags", "source", "confidence", "annotated_at", "best_similarity", "original_source"
    )
    return txns.join(label, "id", how)


def list_transactions(
    txns: DataFrame, anns: DataFrame, *, statement: str | None = None, month: str | None = None, categories: list[str] | None = None, sources: list[str] | None = None, merchant: str | None = None
) -> DataFrame:
    """Rows in scope, in the order (txn_date, id). Filters that are not given don't narrow."""
    rows = labelled(txns, anns)
    if statement:
        rows = rows.where(F.col("statement_id") == statement)
    if month:
        rows = rows.where(S.month_of(F.col("txn_date")) == month)
    if categories:
        rows = rows.where(F.col("category").isin(categories))
    if sources:
        rows = rows.where(F.col("source").isin(sources))
    if merchant:
        rows = rows.where(F.lower("merchant") == merchant.lower())
    return rows.orderBy("txn_date", "id")


def search_transactions(txns: DataFrame, anns: DataFrame, text: str) -> DataFrame:
    """Case-insensitive literal substring over description, merchant and note."""
    low = text.lower()
    has = lambda c: F.coalesce(F.lower(c).contains(low), F.lit(False))
    return labelled(txns, anns).where(has("raw_description") | has("merchant") | has("note"))


def unannotated(txns: DataFrame, anns: DataFrame) -> DataFrame:
    return txns.join(anns.select(F.col("transaction_id").alias("id")), "id", "left_anti")


def page_after(rows: DataFrame, cursor: Column | None, limit: int) -> DataFrame:
    """The next ``limit`` rows of each ledger in the order (txn_date, id) after ``cursor``, an id; an unknown one is ignored."""
    place = Window.partitionBy("ledger_id").orderBy("txn_date", "id")
    if cursor is not None:
        at = rows.where(F.col("id") == cursor).select("ledger_id", F.struct("txn_date", "id").alias("_at"))
        rows = rows.join(at, "ledger_id", "left").where(F.col("_at").isNull() | (F.struct("txn_date", "id") > F.col("_at"))).drop("_at")
    return rows.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= limit).drop("_n")


def facets(rows: DataFrame) -> DataFrame:
    """Distinct labels and sources of each ledger: ledger_id, facet, value."""
    one = lambda c: rows.where(F.col(c).isNotNull()).select("ledger_id", F.lit(c).alias("facet"), F.col(c).alias("value"))
    return one("category").union(one("source")).distinct()


def search_directory(people: DataFrame, groups: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """People by name or token and groups by name that hold ``text``, the first ``limit`` of each ledger by name."""
    low = text.lower()
    who = people.where(F.lower("name").contains(low) | F.coalesce(F.lower("upi").contains(low), F.lit(False))).select("ledger_id", F.lit("person").alias("kind"), "id", "name")
    what = groups.where(F.lower("name").contains(low)).select("ledger_id", F.lit("group").alias("kind"), "id", "name")
    place = Window.partitionBy("ledger_id", "kind").orderBy("name", "id")
    return who.union(what).withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= limit).drop("_n")


#: Words that mark a counterparty as a merchant.
MERCHANT_HINTS = (
    "ZOMATO", "SWIGGY", "ZEPTO", "BLINKIT", "DISTRICT DINING", "RAPIDO", "UBER",
    "OLA", "URBAN", "LIMITED", "LTD", "ENTERP", "OBEROI", "PVR", "RAILWAY",
    "SPOTIFY", "LICIOUS", "MARKETPLA", "BHARATPE", "INDMONEY", "PAYTM", "APPLE",
    "LINKEDIN", "PRACTO", "NETFLIX", "AMAZON", "INOX",
)


def personal_cohort(key: Column) -> Column:
    """Whether a counterparty key holds no merchant's word."""
    return ~key.rlike("|".join(MERCHANT_HINTS))
