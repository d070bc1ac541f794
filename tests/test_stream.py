import datetime as dt

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from agoralens.operators import reports
from agoralens.operators.filters import min_tokens, positives
from agoralens.operators.projections import with_clean_text
from agoralens.operators.scoring import BatchScorer, score_posts
from agoralens.operators.windows import count_window, window_stats
from agoralens.schema import POSTS
from agoralens.sources.lake import stream_table
from agoralens.streaming import ingest, scored as st

START = dt.datetime(2024, 1, 1)


def write_posts(spark, path, first, n, mode="overwrite"):
    ids = spark.range(first, first + n)
    moment = F.lit(START) + F.make_dt_interval(mins=F.col("id"))
    ids.select(
        F.col("id").alias("post_id"),
        F.concat(F.lit("sub"), F.col("id") % 3).alias("subreddit"),
        F.lit("t").alias("thread"),
        F.concat(F.lit("é post "), F.col("id"), F.repeat(F.lit(" word"), (F.col("id") % 15).cast("int"))).alias("user_posting"),
        F.lit(1).cast("long").alias("author"),
        moment.cast("timestamp_ntz").alias("post_date"),
        moment.cast("timestamp_ntz").alias("processed_utc"),
        moment.cast("timestamp_ntz").alias("enqueued_utc"),
    ).repartition(5).write.mode(mode).parquet(path)


@pytest.fixture
def lake(spark, tmp_path):
    write_posts(spark, str(tmp_path / "posts"), 0, 300)
    return tmp_path


def scorer(spark):
    calls = spark.sparkContext.accumulator(0)

    def make():
        def score(texts):
            calls.add(len(texts))
            return [(len(t) % 2, 0.5) for t in texts]

        return score

    return BatchScorer(make), calls


def run(spark, lake, model, window=100, max_files=2):
    posts = stream_table(spark, str(lake / "posts"), POSTS, max_files=max_files)
    st.run(st.score_stream(posts, model, str(lake / "silver"), str(lake / "checkpoint"), window=window))


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_stream_equals_batch_with_one_call_per_post(spark, lake):
    model, calls = scorer(spark)
    run(spark, lake, model)
    eligible = min_tokens(with_clean_text(spark.read.parquet(str(lake / "posts")))).cache()
    assert calls.value == eligible.count()
    batch = score_posts(eligible, scorer(spark)[0])
    written = st.read_silver(spark, str(lake / "silver"), st.SCORED).drop("batch_id")
    assert same(written, batch)
    assert same(st.read_positives(spark, str(lake / "silver")).drop("batch_id"), positives(batch))
    assert same(st.read_monthly(spark, str(lake / "silver")), reports.monthly_scored_stats(batch))
    windows = st.read_silver(spark, str(lake / "silver"), st.WINDOWS)
    assert windows.agg(F.sum("posts")).first()[0] == calls.value

    # A restart finds nothing new: no call, no row.
    before = written.count()
    run(spark, lake, model)
    assert calls.value == before == st.read_silver(spark, str(lake / "silver"), st.SCORED).count()

    # New files are scored, and only they.
    write_posts(spark, str(lake / "posts"), 300, 30, "append")
    run(spark, lake, model)
    after = st.read_silver(spark, str(lake / "silver"), st.SCORED)
    assert after.count() == calls.value == min_tokens(with_clean_text(spark.read.parquet(str(lake / "posts")))).count()


def test_replayed_batch_overwrites_itself(spark, lake):
    posts = min_tokens(with_clean_text(spark.read.parquet(str(lake / "posts"))))
    result = score_posts(posts, scorer(spark)[0])
    for _ in range(2):
        st.write_silver(result, str(lake / "silver"), 7, window=100)
    assert st.read_silver(spark, str(lake / "silver"), st.SCORED).count() == posts.count()
    windows = st.read_silver(spark, str(lake / "silver"), st.WINDOWS).drop("batch_id")
    columns = posts.select("post_id", "enqueued_utc").join(result.select("post_id", "prediction"), "post_id")
    assert same(windows, window_stats(count_window(columns, ["enqueued_utc", "post_id"], 100)))


def test_windows_go_on_across_batches(spark, tmp_path):
    """Four deliveries in time order, each a batch of its own; a window of 70 posts spans them."""
    for k in range(4):
        write_posts(spark, str(tmp_path / "posts"), 100 * k, 100, "append")
        run(spark, tmp_path, scorer(spark)[0], window=70, max_files=None)
    root = str(tmp_path / "silver")
    scored = st.read_silver(spark, root, st.SCORED)
    assert scored.select("batch_id").distinct().count() == 4
    columns = scored.select("post_id", "enqueued_utc", "prediction")
    right = window_stats(count_window(columns, ["enqueued_utc", "post_id"], 70))
    assert same(st.read_windows(spark, root), right)
    posts = [r.posts for r in right.orderBy("window_no").collect()]
    assert len(posts) > 2 and set(posts[:-1]) == {70}

    # A batch that is replayed begins where it began.
    batch = spark.createDataFrame(scored.filter("batch_id = 1").drop("batch_id").collect(), scored.drop("batch_id").schema)
    st.write_silver(batch, root, 1, window=70)
    assert same(st.read_windows(spark, root), right)


def test_time_bound(spark, lake):
    posts = stream_table(spark, str(lake / "posts"), POSTS)
    name = "bounded_posts"
    st.run(st.stream_to_memory(st.eligible_posts(posts, "2024-01-01 03:00:00", n=0), name))
    found = [r.post_id for r in st.stream_result(spark, name).collect()]
    assert found == list(range(180, 300))


def test_complete_mode_needs_an_aggregate(spark, lake):
    posts = stream_table(spark, str(lake / "posts"), POSTS)
    with pytest.raises(AnalysisException):
        posts.writeStream.format("memory").queryName("rejected").outputMode("complete").start()


def test_ingest_keeps_broken_lines(spark, tmp_path):
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "a.txt").write_text('{"post_id": 1, "subreddit": "a"}\nbroken {\n{"post_id": 2}\n')
    stream = spark.readStream.text(str(tmp_path / "lines"))
    schema = StructType([POSTS["post_id"], POSTS["subreddit"]])
    for _ in range(2):  # the second run reads nothing new
        st.run(ingest.ingest_json(stream, schema, str(tmp_path / "bronze"), str(tmp_path / "checkpoint")))
    rows = spark.read.parquet(str(tmp_path / "bronze")).collect()
    assert sorted((r.post_id or 0, r.subreddit, r._corrupt_record) for r in rows) == [
        (0, None, "broken {"),
        (1, "a", None),
        (2, None, None),
    ]
    assert all(r.processed_utc for r in rows)


def test_processing_time_is_utc_in_any_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Bogota")
    try:
        lines = spark.createDataFrame([("{}",)], "value string")
        moment = ingest.parse_events(lines, StructType([POSTS["post_id"]])).select(F.col("processed_utc").cast("string")).head()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert abs(dt.datetime.fromisoformat(moment) - dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)) < dt.timedelta(minutes=5)


def test_a_batch_of_one_file_is_shared_by_all_cores(spark, tmp_path, monkeypatch):
    """Before, a file was a task; and a batch of few posts was numbered in as many ranges as shuffles have partitions."""
    seen, real = [], st.count_window
    monkeypatch.setattr(st, "count_window", lambda *args: seen.append(args[5:]) or real(*args))
    write_posts(spark, str(tmp_path / "many"), 0, 300)
    spark.read.parquet(str(tmp_path / "many")).coalesce(1).write.parquet(str(tmp_path / "posts"))
    run(spark, tmp_path, scorer(spark)[0], max_files=1)
    found = st.read_silver(spark, str(tmp_path / "silver"), st.SCORED)
    shares = [r["count"] for r in found.groupBy(F.input_file_name()).count().collect()]
    assert len(shares) == spark.sparkContext.defaultParallelism and max(shares) < 2 * sum(shares) / len(shares)
    assert seen == [(1,)]


def test_posts_are_cleaned_once_and_after_they_were_spread(spark, tmp_path, plan_of):
    """Before, the optimizer moved the threshold, and a cleaning for it, into the one task that reads a file."""
    write_posts(spark, str(tmp_path / "posts"), 0, 60)
    posts = spark.read.schema(POSTS).parquet(str(tmp_path / "posts"))
    eligible = st.eligible_posts(st.spread(posts))
    plan = plan_of(eligible)
    behind = plan[plan.index("Exchange") :]
    assert "regexp" not in behind and plan.count("regexp_extract_all") == 1
    assert eligible.columns == [*posts.columns, "token_count"]
    assert same(eligible, min_tokens(with_clean_text(posts)))


def test_one_range_is_numbered_without_a_join(spark, plan_of):
    rows = spark.range(50).select((F.col("id") * 7 % 50).alias("x"), F.lit("t").alias("y"))
    numbered = count_window(rows, ["x"], 20, start=15, ranges=1)
    assert "Join" not in plan_of(numbered)
    assert sorted((r.x, r.position, r.window_no) for r in numbered.collect()) == [(k, k + 15, (k + 15) // 20) for k in range(50)]
    assert same(numbered, count_window(rows, ["x"], 20, start=15, ranges=4))
