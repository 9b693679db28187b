"""Named queries of the spatial operators, each with SQL of the same meaning."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with SQL for DuckDB where SQL can express it."""

    def registered(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return registered


def _loaded() -> None:
    for module in ("scalar", "relational", "procedural"):
        importlib.import_module(f"geolith.plans.{module}")


def queries() -> dict[str, Query]:
    _loaded()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _loaded()
    return dict(_sql)
