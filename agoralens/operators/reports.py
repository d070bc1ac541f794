"""Counts and token statistics by time and community."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from agoralens.functions.time import day_bucket, month_bucket
from agoralens.operators.dedup import distinct_posts


def posts_by_year_month(df: DataFrame, date: str = "post_date") -> DataFrame:
    return df.groupBy(F.year(date).alias("year"), F.month(date).alias("month")).count()


def posts_by_year(df: DataFrame, date: str = "post_date") -> DataFrame:
    return df.groupBy(F.year(date).alias("year")).count()


def total_posts(counts: DataFrame) -> DataFrame:
    """Sum of the counts of one of the reports above."""
    return counts.agg(F.sum("count").alias("sum_count"))


def dedup_posts_by_year_month(df: DataFrame, date: str = "post_date") -> DataFrame:
    return posts_by_year_month(distinct_posts(df, [date]), date)


def _token_stats(bucketed: DataFrame, bucket: str, *more) -> DataFrame:
    return bucketed.groupBy(bucket, "subreddit").agg(
        F.count("user_posting").alias("post_count"),
        F.sum("token_count").alias("total_token_count"),
        F.avg("token_count").alias("avg_token_count"),
        *more,
    )


def daily_token_stats(df: DataFrame) -> DataFrame:
    return _token_stats(df.withColumn("post_date", day_bucket(F.col("post_date"))), "post_date")


def monthly_token_stats(df: DataFrame) -> DataFrame:
    return _token_stats(df.withColumn("month", month_bucket(F.col("post_date"))), "month")


def monthly_scored_stats(df: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Monthly token statistics plus the number of positive posts."""
    return _token_stats(
        df.withColumn("month", month_bucket(F.col("post_date"))),
        "month",
        F.count_if(F.col(prediction) == 1).alias("prediction_1"),
    )


def monthly_partials(df: DataFrame) -> DataFrame:
    """The additive parts of `monthly_scored_stats`, for one batch of a stream."""
    return (
        df.withColumn("month", month_bucket(F.col("post_date")))
        .groupBy("month", "subreddit")
        .agg(
            F.count("user_posting").alias("post_count"),
            F.sum("token_count").alias("total_token_count"),
            F.count("token_count").alias("counted_posts"),
            F.count_if(F.col("prediction") == 1).alias("prediction_1"),
        )
    )


def add_partials(partials: DataFrame) -> DataFrame:
    """Partials of several batches as partials of one."""
    parts = ("post_count", "total_token_count", "counted_posts", "prediction_1")
    return partials.groupBy("month", "subreddit").agg(*(F.sum(c).alias(c) for c in parts))


def merge_partials(partials: DataFrame) -> DataFrame:
    """Combine the partials of all batches; no scored row is read again."""
    return partials.groupBy("month", "subreddit").agg(
        F.sum("post_count").alias("post_count"),
        F.sum("total_token_count").alias("total_token_count"),
        F.try_divide(F.sum("total_token_count"), F.sum("counted_posts")).alias("avg_token_count"),
        F.sum("prediction_1").alias("prediction_1"),
    )
