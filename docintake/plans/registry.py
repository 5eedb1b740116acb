"""Queries of the library by name, with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docintake.sources.views import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str) -> Callable[[Query], Query]:
    """Register a query under ``name``; ``sql`` may use the named views."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = with_views(sql, *views) if views else sql
        return f

    return add


#: Modules that register queries when imported.
FAMILIES = ("workflow", "queue", "reports", "calendars", "messages", "layout", "figures", "gates", "articles", "streams", "sources")


def load_all() -> None:
    for m in FAMILIES:
        importlib.import_module(f"docintake.plans.{m}")
