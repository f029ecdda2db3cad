"""What the query modules share: derived tables by name and common SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom import fixtures
from ledgerloom.operators import listing
from ledgerloom.thresholds import NON_SPEND


class Ledger:
    """The derived tables of one data folder as attributes.

    The tables that stand for stored ones are checkpointed, so that a query that reads
    them in several places derives them once and its plan stays small.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        return fixtures.spark_table(self._spark, self._dir, name, self._made)

    @property
    def rows(self) -> DataFrame:
        """Transactions with their labels."""
        if "rows" not in self._made:
            self._made["rows"] = fixtures.checkpointed(listing.labelled(self.transactions, self.annotations))
        return self._made["rows"]


#: SQL of the same: transactions with labels, months, and spend categories.
ROWS = """SELECT t.*, a.id AS annotation_id, a.merchant, a.category, a.subcategory, a.source, a.confidence, a.annotated_at, a.best_similarity, a.original_source,
  substr(CAST(t.txn_date AS STRING), 1, 7) AS month, coalesce(a.category, 'Uncategorized') AS spend_cat
FROM transactions t LEFT JOIN annotations a ON a.transaction_id = t.id"""
NON = "(" + ", ".join(f"'{c}'" for c in NON_SPEND) + ")"
