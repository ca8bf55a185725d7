"""Where queries are entered by name, each with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Enter a function (spark, sf_dir) under its own name, or under *name*."""

    def enter(f: Query) -> Query:
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"entered twice: {key}")
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return enter
