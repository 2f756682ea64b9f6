"""Names of the registered queries, each with its function of (spark, sf_dir) and, where there is one, its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mediasift.plans import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, tables: str = ""):
    """Register a query. ``sql`` is a SELECT over the fixture tables and ``tables`` (further common table expressions)."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = "WITH RECURSIVE " + fixtures.SQL.strip() + (",\n" + tables.strip().rstrip(",") if tables else "") + "\n" + sql.strip()
        return fn

    return add
