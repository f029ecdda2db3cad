"""All queries over the given tables, and the SQL that must give the same rows."""

from __future__ import annotations

import functools
import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
PLANS = ("scalar_plans", "listing_plans", "insight_plans", "label_plans", "merge_plans", "statement_plans", "io_plans")
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, dates: str = "") -> Callable[[Query], Query]:
    """Register a function as a query under its own name, with its SQL if there is one.

    Columns named in ``dates`` leave both as text, so that no reader's date type matters.
    """

    def add(fn: Query) -> Query:
        names = dates.split()

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = fn(spark, sf_dir)
            return out.withColumns({c: out[c].cast("string") for c in names}) if names else out

        _QUERIES[fn.__name__] = run
        if sql:
            as_text = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in names)
            _SQL[fn.__name__] = f"SELECT * REPLACE ({as_text}) FROM ({sql})" if names else sql
        return run

    return add


def _load() -> None:
    for name in PLANS:
        importlib.import_module(f"ledgerloom.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _SQL
