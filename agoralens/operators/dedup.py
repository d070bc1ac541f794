"""Removal of redelivered posts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from agoralens.schema import POST_KEYS


def dedup_posts(df: DataFrame, keys: list[str] = POST_KEYS) -> DataFrame:
    """One row per key, whichever arrives first in the plan.

    Only the keys are stable, so only they should be read from the result;
    `first_per_key` also fixes the other columns.
    """
    return df.dropDuplicates(keys)


def first_per_key(df: DataFrame, order: list[str], keys: list[str] = POST_KEYS) -> DataFrame:
    """Per key, the first row in `order`.

    `row_number() = 1` lets Spark cut every group to one row before the
    shuffle, so a post delivered a million times moves once per map task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")


def distinct_posts(df: DataFrame, keep: list[str], keys: list[str] = POST_KEYS) -> DataFrame:
    """Distinct posts reduced to the key columns in `keep`.

    For counting, the text only has to be compared: its SHA-256 digest takes
    its place in the shuffle, 32 bytes instead of a whole post.
    """
    plain = [k for k in keys if k != "user_posting"]
    digest = F.unhex(F.sha2(F.col("user_posting"), 256)).alias("_text")
    return df.select(*plain, digest).distinct().select(*keep)
