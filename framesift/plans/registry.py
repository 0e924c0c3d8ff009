"""Where registered queries and their SQL counterparts are collected."""

from __future__ import annotations

from collections.abc import Callable

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from framesift.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without `sql` it is tested on fixtures instead."""
    def add(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        @wraps(run)
        def shipped(spark: SparkSession, sf: str) -> DataFrame:
            return run(ship_package(spark), sf)
        QUERIES[name] = shipped
        if sql is not None:
            ORACLES[name] = sql.strip()
        return run
    return add
