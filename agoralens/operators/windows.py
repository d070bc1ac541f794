"""Windows of a fixed number of posts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from agoralens.session import materialise, scratch_path

# Fixed value: posts per evaluation window.
WINDOW_POSTS = 1000

# Bits of the row number in `monotonically_increasing_id`.
ROW_BITS = 33


def count_window(
    df: DataFrame, order: list[str], size: int = WINDOW_POSTS, scratch: str | None = None, start: int = 0, ranges: int | None = None
) -> DataFrame:
    """Number the rows in `order` and put every `size` of them into one window.

    Adds `position` (from `start`) and `window_no`. `order` should tell rows apart;
    rows equal in it are numbered in an order of their own.

    A global row number in one window would pull all rows into one task.
    Instead the rows are range-partitioned and sorted, numbered within each
    range, and shifted by the number of rows in the ranges before. The range
    bounds come from a sample, so the numbered rows are written once: counting
    and shifting must see the same ranges. They are shuffled only once. A row
    id ends the sort key, so that a value held by very many rows is spread over
    several ranges.

    `ranges` is how many there are; by default as many as shuffles have partitions.

    `scratch` is a folder of the caller for the two written frames; a stream
    passes one, so that its batches reuse it. If `df` calls a scorer, write it
    first: the sampling reads it once more.
    """
    spark = df.sparkSession
    scratch = scratch or scratch_path(spark, "count-window")
    partitions = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*order, "_id"]
    # After the sort, the id holds the partition in its upper 31 bits and the
    # row within the partition in its lower 33.
    ranged = materialise(
        df.withColumn("_id", F.monotonically_increasing_id())
        .repartitionByRange(partitions, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_id", F.monotonically_increasing_id()),
        f"{scratch}/ranged",
    )
    in_range = F.shiftright("_id", ROW_BITS).alias("_range")
    row = F.col("_id").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    window_no = F.expr(f"position div {int(size)}")
    if partitions == 1:  # nothing comes before the only range
        return ranged.withColumn("position", row + F.lit(start)).withColumn("window_no", window_no).select(*df.columns, "position", "window_no")
    # One row per range: the window without partition sees `partitions` rows.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialise(
        ranged.groupBy(in_range)
        .agg(F.count("*").alias("_rows"))
        .select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")),
        f"{scratch}/offsets",
    )
    return (
        ranged.withColumn("_range", in_range)
        .join(offsets, "_range")
        .withColumn("position", F.col("_before") + row + F.lit(start))
        .withColumn("window_no", window_no)
        .select(*df.columns, "position", "window_no")
    )


def window_stats(windowed: DataFrame, time: str = "enqueued_utc") -> DataFrame:
    """Posts, scored posts and positives of every window."""
    return windowed.groupBy("window_no").agg(
        F.count("*").alias("posts"),
        F.count("prediction").alias("scored"),
        F.count_if(F.col("prediction") == 1).alias("prediction_1"),
        F.min(time).alias("first_time"),
        F.max(time).alias("last_time"),
    )


def merge_window_stats(partials: DataFrame) -> DataFrame:
    """Statistics of windows of which several partials may exist."""
    sums = (F.sum(c).alias(c) for c in ("posts", "scored", "prediction_1"))
    return partials.groupBy("window_no").agg(*sums, F.min("first_time").alias("first_time"), F.max("last_time").alias("last_time"))
