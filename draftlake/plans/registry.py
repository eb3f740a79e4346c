"""Name → (Spark query, oracle SQL)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from draftlake.plans.fixtures import Source, open_source


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register ``fn(source) -> DataFrame`` under ``name``."""

    def add(fn: Callable[[Source], DataFrame]) -> Callable[[Source], DataFrame]:
        QUERIES[name] = Query(lambda spark, folder: fn(open_source(spark, folder)), sql)
        return fn

    return add


def r6(column: Column | str) -> Column:
    """Six decimals, with -0.0 folded into 0.0."""
    return F.round(column, 6) + F.lit(0.0)


def joined(column: Column | str) -> Column:
    return F.array_join(column, "|")
