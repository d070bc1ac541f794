"""Merged summaries against exact figures."""

import random
from collections import Counter

from pyspark.sql import functions as F

from agoralens.operators import sketches


def test_merged_quantiles_keep_their_rank_error(spark):
    df = spark.range(200_000).selectExpr("pmod(xxhash64(id), 100000) / 7 v", "id % 50 day", "id % 2 label")
    merged = sketches.merge_quantiles(sketches.quantile_partials(df, "v", ["day", "label"]), ["label"])
    ps = [0.01, 0.25, 0.5, 0.75, 0.99]
    rows = sketches.sketched_quantiles(merged, ps).collect()
    assert len(rows) == 10
    values = {k: sorted(r.v for r in df.filter(F.col("label") == k).select("v").collect()) for k in (0, 1)}
    for r in rows:
        rank = sum(v <= r.quantile for v in values[r.label]) / len(values[r.label])
        assert abs(rank - r.p) <= sketches.RANK_ERROR


def test_distinct_counts_of_a_union(spark):
    df = spark.range(60_000).selectExpr("id % 30000 v", "id % 12 month")
    assert sketches.merge_distinct(sketches.distinct_partials(df, "v", ["month"]), []).head().estimate / 30_000 - 1 < sketches.HLL_ERROR


def test_frequent_tokens_are_bounded_and_found(spark):
    rng, batches = random.Random(2), []
    for b in range(6):
        batches.append(Counter(f"t{min(int(rng.expovariate(0.05)), 300)}" for _ in range(3000)))
    batches.append(Counter({"alone": 2}))
    keep, total = 15, sum(batches, Counter())
    parts = None
    for b, counts in enumerate(batches):
        df = spark.createDataFrame(list(counts.items()), "token string, n long")
        part = sketches.frequent_partial(df, keep).withColumn("batch_id", F.lit(b))
        parts = part if parts is None else parts.union(part)
    found = {r.token: (r.at_least, r.at_most) for r in sketches.merge_frequent(parts).collect()}
    cuts = sum(sorted(c.values(), reverse=True)[keep] for c in batches if len(c) > keep)
    assert all(low <= total[t] <= high for t, (low, high) in found.items())
    assert {t for t, n in total.items() if n > cuts} <= set(found)
    whole = sketches.merge_frequent(sketches.frequent_partial(spark.createDataFrame(list(total.items()), "token string, n long"), 10_000).withColumn("batch_id", F.lit(0)))
    assert {r.token: r.at_least for r in whole.collect()} == dict(total) and whole.filter("at_least <> at_most").count() == 0
