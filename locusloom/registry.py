"""Registered queries: each operator bound to tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: The query of ``entry``.
FLAGSHIP = "areas_by_rule"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function of (session, folder) under a name, with its oracle."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"registered twice: {name}")
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add
