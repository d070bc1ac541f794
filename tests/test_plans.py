"""What the plans must and must not contain."""

import pytest

import __spark_entry__ as entry
from agoralens.operators import corpus, dedup, filters
from agoralens.sources import fixtures, lake

SF_DIR = "/root/testdata/sf0.001"

NO_PYTHON = [
    "clean_text",
    "token_count",
    "monthly_token_stats",
    "monthly_scored_stats",
    "score_posts_lexicon",
    "clean_tokens",
    "token_frequency",
    "top_clean_tokens",
    "vocabulary",
    "term_matrix",
    "label_density",
    "iqr_outliers",
    "parse_reply",
]


@pytest.mark.parametrize("name", NO_PYTHON)
def test_no_python_and_no_cross_join(spark, plan_of, name):
    plan = plan_of(entry.queries()[name](spark, SF_DIR))
    for word in ("EvalPython", "InPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan


@pytest.mark.parametrize("name", ["token_frequency", "top_clean_tokens", "preview", "term_weights"])
def test_top_k_is_no_full_sort(spark, plan_of, name):
    assert "TakeOrderedAndProject" in plan_of(entry.queries()[name](spark, SF_DIR))


def test_report_has_one_shuffle_and_partial_aggregation(spark, plan_of, tmp_path):
    fixtures.posts(spark, SF_DIR).write.parquet(lake.zone_path("bronze", "posts", str(tmp_path)))
    from agoralens.operators.projections import with_clean_text
    from agoralens.operators.reports import monthly_token_stats

    posts = lake.read_table(spark, "bronze", "posts", root=str(tmp_path))
    plan = plan_of(monthly_token_stats(with_clean_text(posts)))
    assert plan.count("Exchange") == 1 and "partial_sum" in plan
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert scan.count("string") == 2 and "thread" not in scan and "author" not in scan


def test_time_bound_reaches_the_scan(spark, plan_of, tmp_path):
    fixtures.posts(spark, SF_DIR).write.parquet(lake.zone_path("bronze", "posts", str(tmp_path)))
    posts = lake.read_table(spark, "bronze", "posts", root=str(tmp_path))
    plan = plan_of(filters.since(posts, "processed_utc", "2024-01-15"))
    assert "GreaterThanOrEqual(processed_utc" in plan


def test_dedup_reduces_before_the_shuffle(spark, plan_of, tmp_path):
    fixtures.posts(spark, SF_DIR).write.parquet(str(tmp_path / "posts"))
    plan = plan_of(dedup.first_per_key(spark.read.parquet(str(tmp_path / "posts")), ["enqueued_utc"]))
    assert "row_number(), 1, Partial" in plan


def test_token_reports_shuffle_counts_not_tokens(spark, plan_of):
    for name in ("token_frequency", "vocabulary", "top_clean_tokens"):
        assert "partial_count" in plan_of(entry.queries()[name](spark, SF_DIR))


def test_stop_words_are_broadcast_and_tokens_stay_in_place(spark, plan_of, tmp_path):
    fixtures.table(spark, SF_DIR, "documents").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    for fold in (False, True):
        plan = plan_of(corpus.clean_tokens(docs, corpus.stop_words(spark, "spanish", fold)))
        assert "LeftAnti, BuildRight" in plan and "SortMergeJoin" not in plan
    assert "Exchange hashpartitioning" not in plan_of(corpus.clean_tokens(docs, corpus.stop_words(spark, "spanish")))


def test_big_lookup_is_shuffled_not_broadcast(spark, plan_of, tmp_path):
    """No hint: beyond the size threshold the join falls back to a shuffle."""
    spark.range(2000).selectExpr("cast(id as string) token").write.parquet(str(tmp_path / "stops"))
    tokens = spark.range(10).selectExpr("cast(id as string) token")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1KB")
    try:
        joined = corpus.remove_stop_words(tokens, spark.read.parquet(str(tmp_path / "stops")))
        assert "BroadcastHashJoin" not in plan_of(joined) and joined.count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
