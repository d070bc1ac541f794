import datetime as dt

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from agoralens.operators import dedup, reports
from agoralens.operators.projections import as_category, normalise_names, select_gold, with_doc_key
from agoralens.schema import GOLD_COLUMNS, POSTS, RAW_NAMES

DAY = dt.datetime(2024, 1, 31, 23, 59)
SCORED = "post_id long, subreddit string, post_date timestamp_ntz, user_posting string, token_count int, prediction int"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def scored(spark):
    return spark.createDataFrame(
        [
            (1, "a", DAY, "x", 20, 1),
            (2, "a", DAY, "y", 10, None),
            (3, "a", DAY + dt.timedelta(minutes=2), "z", 12, 0),
            (4, "b", DAY, None, None, None),
            (5, "b", DAY, "w", 11, -1),
        ],
        SCORED,
    )


def test_monthly_scored_stats(spark):
    assert rows(reports.monthly_scored_stats(scored(spark))) == [
        ("2024-01", "a", 2, 30, 15.0, 1),
        ("2024-01", "b", 1, 11, 11.0, 0),
        ("2024-02", "a", 1, 12, 12.0, 0),
    ]


def test_group_of_nulls(spark):
    empty = scored(spark).filter("post_id = 4")
    assert rows(reports.monthly_scored_stats(empty)) == [("2024-01", "b", 0, None, None, 0)]
    assert rows(reports.merge_partials(reports.monthly_partials(empty))) == [("2024-01", "b", 0, None, None, 0)]


def test_partials_of_batches_merge_to_the_whole(spark):
    df = scored(spark)
    parts = [reports.monthly_partials(df.filter(F.col("post_id") % 2 == i)) for i in (0, 1)]
    assert rows(reports.merge_partials(parts[0].unionByName(parts[1]))) == rows(reports.monthly_scored_stats(df))


def test_daily_stats_split_at_midnight(spark):
    days = {r.post_date for r in reports.daily_token_stats(scored(spark)).collect()}
    assert days == {dt.date(2024, 1, 31), dt.date(2024, 2, 1)}


def test_total_names_its_column(spark):
    total = reports.total_posts(reports.posts_by_year(scored(spark)))
    assert total.columns == ["sum_count"] and total.first().sum_count == 5


post = st.tuples(
    st.integers(0, 2), st.sampled_from(["a", "b"]), st.none(), st.sampled_from(["x", "y", None]), st.integers(0, 1),
    st.sampled_from([DAY, DAY + dt.timedelta(days=1)]), st.just(DAY), st.integers(0, 3).map(lambda h: DAY + dt.timedelta(hours=h)),
)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(posts=st.lists(post, min_size=10, max_size=60))
def test_dedup(spark, posts):
    df = spark.createDataFrame(posts, POSTS)
    key = [POSTS.fieldNames().index(k) for k in dedup.POST_KEYS]
    keys = {tuple(p[i] for i in key) for p in posts}
    first = dedup.first_per_key(df, ["enqueued_utc"])
    assert dedup.dedup_posts(df).count() == first.count() == dedup.distinct_posts(df, ["post_date"]).count() == len(keys)
    assert dedup.first_per_key(first, ["enqueued_utc"]).count() == len(keys)
    earliest = {k: min(p[7] for p in posts if tuple(p[i] for i in key) == k) for k in keys}
    found = {tuple(r[k] for k in dedup.POST_KEYS): r.enqueued_utc for r in first.collect()}
    assert found == earliest
    by_month = reports.posts_by_year_month(df).agg(F.sum("count")).first()[0]
    assert by_month == len(posts)


def test_names_and_gold_columns(spark):
    raw = spark.createDataFrame([tuple([None] * len(RAW_NAMES))], ", ".join(f"`{c}` string" for c in RAW_NAMES))
    assert normalise_names(raw).columns == list(RAW_NAMES.values())
    wide = spark.createDataFrame([tuple("x" * (len(GOLD_COLUMNS) + 1))], ["extra", *GOLD_COLUMNS])
    assert select_gold(wide).columns == GOLD_COLUMNS


def test_doc_key_tells_null_from_empty(spark):
    df = spark.createDataFrame([("a", None), ("a", ""), ("a", "-"), (None, "a")], "x string, y string")
    assert with_doc_key(df, "x", "y").select("doc_key").distinct().count() == 4


def test_category(spark):
    assert dict(as_category(spark.range(1), "id").dtypes) == {"id": "string"}
