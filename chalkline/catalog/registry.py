"""Registered queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chalkline.catalog.views import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _utc(spark: SparkSession) -> SparkSession:
    """Times of the data model are UTC, whatever session the driver brings."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query over the derived tables; `sql` is the independent statement DuckDB runs."""

    def add(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, folder: fn(Tables(_utc(spark), folder))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return add
