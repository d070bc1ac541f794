"""Named queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from agoralens.session import scratch_scope, ship_package, use_utc

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function under its name, with its SQL if there is one."""

    def register(function: Query) -> Query:
        key = name or function.__name__

        def call(spark: SparkSession, sf_dir: str) -> DataFrame:
            # What a query writes on its way is gone when it returns; what its result reads stays.
            with scratch_scope(ship_package(use_utc(spark))) as scope:
                return scope.keep(function(spark, sf_dir))

        call.__name__, call.__doc__ = key, function.__doc__
        QUERIES[key] = call
        if sql:
            ORACLES[key] = sql
        return function

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round floating results, so that engines may add up in any order."""
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})
