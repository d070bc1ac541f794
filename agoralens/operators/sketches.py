"""Summaries that are stored by day, month or batch and merged later: quantiles, distinct counts, frequent tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Size of a quantile sketch; its rank error is below RANK_ERROR with 99 % confidence.
KLL_SIZE = 400
RANK_ERROR = 0.01
#: Log of the registers of a distinct-count sketch; its error is below 3 of its standard deviations of 1.04 / sqrt(registers).
HLL_LOG = 12
HLL_ERROR = 3 * 1.04 / 2 ** (HLL_LOG / 2)
#: Tokens that a batch's summary keeps.
FREQUENT = 1000


# --- quantiles ----------------------------------------------------------------


def quantile_partials(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """A sketch of the values for each key, such as a day and a label; a few kilobytes whatever the number of rows."""
    return df.groupBy(*keys).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), KLL_SIZE).alias("sketch"))


def merge_quantiles(partials: DataFrame, keys: list[str]) -> DataFrame:
    return partials.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def sketched_quantiles(merged: DataFrame, probabilities: list[float]) -> DataFrame:
    """A row (keys, p, quantile) for each probability."""
    keys = [c for c in merged.columns if c != "sketch"]
    ps = F.array(*(F.lit(p) for p in probabilities))
    quantiles = F.kll_sketch_get_quantile_double("sketch", ps)
    return merged.select(*keys, F.inline(F.arrays_zip(ps.alias("p"), quantiles.alias("quantile"))).alias("p", "quantile"))


# --- distinct counts ------------------------------------------------------------


def distinct_partials(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.hll_sketch_agg(value, F.lit(HLL_LOG)).alias("sketch"))


def merge_distinct(partials: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, estimate): distinct values over all partials of a key."""
    return partials.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


# --- frequent tokens --------------------------------------------------------------


def frequent_partial(counts: DataFrame, keep: int = FREQUENT) -> DataFrame:
    """(token, n) of the `keep` most frequent tokens of a batch, and in a row without token the largest count left out."""
    top = counts.orderBy(F.desc("n"), "token").limit(keep + 1)
    # Without a partition, but over the keep + 1 rows of the summary only.
    ranked = top.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(F.desc("n"), "token")))
    return ranked.select(F.when(F.col("rank") <= keep, F.col("token")).alias("token"), "n")


def merge_frequent(partials: DataFrame, batch: str = "batch_id") -> DataFrame:
    """(token, at_least, at_most) over all batches.

    A batch that doesn't list a token holds it at most as often as the largest
    count that it left out. A token that is more frequent than these counts
    together is listed by some batch, so it is in the result.
    """
    cut = partials.filter("token is null")
    all_cuts = F.coalesce(cut.agg(F.sum("n")).scalar(), F.lit(0))
    cuts = cut.select(F.col(batch).alias("_batch"), F.col("n").alias("cut"))
    listed = partials.filter("token is not null").join(cuts, F.col(batch) == F.col("_batch"), "left")
    sums = listed.groupBy("token").agg(F.sum("n").alias("at_least"), F.sum(F.coalesce("cut", F.lit(0))).alias("own_cuts"))
    return sums.select("token", "at_least", (F.col("at_least") + all_cuts - F.col("own_cuts")).alias("at_most"))
