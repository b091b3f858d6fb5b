"""Registered queries and the SQL that an independent engine checks them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a query, with its oracle if SQL can express it."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def _load() -> None:
    from importlib import import_module

    for name in MODULES:
        import_module(f"tidemark.plans.{name}")


#: Modules that register queries.
MODULES = ["series_queries", "feature_queries", "evaluation_queries", "cohort_queries", "selection_queries", "result_queries", "other_queries", "recording_queries", "matrix_queries"]
_load()
