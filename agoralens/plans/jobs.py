"""Whole jobs, put together from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from agoralens.functions.text import token_count
from agoralens.operators.dedup import first_per_key
from agoralens.operators.projections import normalise_names, select_gold, with_clean_text
from agoralens.operators.reports import monthly_scored_stats
from agoralens.operators.scoring import score_posts
from agoralens.schema import MIN_TOKENS
from agoralens.sources.lake import read_table, write_gold, zone_path


def score_bronze(
    spark: SparkSession,
    root: str,
    scorer,
    bronze: str = "posts",
    gold: str = "post_predictions",
    fmt: str = "parquet",
    dedup: bool = False,
    n: int = MIN_TOKENS,
    counter=token_count,
    partition_by: str | None = None,
) -> DataFrame:
    """Bronze posts to a scored gold table; returns the monthly report on it.

    Redeliveries are removed before scoring if `dedup` is set: the scorer is
    the dearest step. The report reads the gold table, not the scorer.
    """
    posts = normalise_names(read_table(spark, "bronze", bronze, fmt, root))
    if dedup:
        posts = first_per_key(posts, ["enqueued_utc", "processed_utc", "thread"])
    scored = score_posts(with_clean_text(posts, counter), scorer, n)
    written = write_gold(select_gold(scored), zone_path("gold", gold, root), fmt, partition_by)
    return monthly_scored_stats(written)
