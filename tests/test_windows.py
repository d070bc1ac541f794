import random

import pytest
from pyspark.sql import functions as F

from agoralens.operators.windows import count_window, window_stats


@pytest.mark.parametrize("hot", [0.0, 0.5, 1.0])
def test_positions_equal_a_sort(spark, hot):
    """Also with half or all of the rows at one moment."""
    rng = random.Random(3)
    rows = [(0 if rng.random() < hot else rng.randrange(10_000), i) for i in range(3_500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "t long, id long").repartition(5)
    found = count_window(df, ["t", "id"]).orderBy("position").collect()
    assert [(r.t, r.id) for r in found] == sorted(rows)
    assert [r.position for r in found] == list(range(3_500))
    assert [r.window_no for r in found] == [p // 1_000 for p in range(3_500)]


def test_equal_rows_are_spread_over_ranges(spark, tmp_path):
    df = spark.range(20_000).select(F.lit(1).alias("t"))
    found = count_window(df, ["t"], scratch=str(tmp_path))
    assert found.agg(F.count_distinct("position")).first()[0] == 20_000
    ranges = spark.read.parquet(str(tmp_path / "ranged")).groupBy(F.shiftright("_id", 33)).count().collect()
    assert len(ranges) == 8 and max(r["count"] for r in ranges) < 6_000


def test_number_of_ranges(spark, tmp_path):
    found = count_window(spark.range(1000).select(F.col("id").alias("t")), ["t"], scratch=str(tmp_path), ranges=3)
    assert sorted(r.position for r in found.collect()) == list(range(1000))
    assert spark.read.parquet(str(tmp_path / "ranged")).select(F.shiftright("_id", 33)).distinct().count() <= 3


def test_stats_and_empty_input(spark):
    df = spark.range(25).select(F.col("id").alias("enqueued_utc"), (F.col("id") % 2).alias("prediction"))
    stats = window_stats(count_window(df, ["enqueued_utc"], 10)).orderBy("window_no").collect()
    assert [(r.posts, r.scored, r.prediction_1, r.first_time, r.last_time) for r in stats] == [
        (10, 10, 5, 0, 9),
        (10, 10, 5, 10, 19),
        (5, 5, 2, 20, 24),
    ]
    assert count_window(df.filter("enqueued_utc < 0"), ["enqueued_utc"]).count() == 0
