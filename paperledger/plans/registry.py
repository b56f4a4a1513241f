"""Where queries and their DuckDB SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .projections import oracle, projection

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None, *inputs: str):
    """Registers a function of the named projections (or base tables)."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(*(projection(spark, sf_dir, i) for i in inputs))
        if sql:
            ORACLE_SQL[name] = oracle(sql)
        return fn

    return add
