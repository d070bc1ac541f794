"""Predicates. Bounds are typed literals on raw columns, so they reach the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from agoralens.schema import MIN_TOKENS


def since(df: DataFrame, column: str, start: str) -> DataFrame:
    """Rows at or after `start`, for batch and streaming frames."""
    bound = F.lit(start).cast(df.schema[column].dataType)
    return df.filter(F.col(column) >= bound)


def min_tokens(df: DataFrame, n: int = MIN_TOKENS) -> DataFrame:
    """Posts with more than `n` tokens; exactly `n` is not enough."""
    return df.filter(F.col("token_count") > n)


def positives(df: DataFrame) -> DataFrame:
    """Posts predicted positive. Apply to written scores, not to a scorer call."""
    return df.filter(F.col("prediction") == 1)


def by_label(df: DataFrame, label: int = 1) -> DataFrame:
    return df.filter(F.col("label") == label)


def outside(value: Column, low: Column, high: Column) -> Column:
    return (value < low) | (value > high)
