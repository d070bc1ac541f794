"""Streams over the bronze posts and over JSON events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType, TimestampNTZType

from agoralens.operators import corpus, sketches
from agoralens.operators.filters import since
from agoralens.operators.projections import normalise_names
from agoralens.operators.scoring import BatchScorer
from agoralens.plans import sql
from agoralens.plans.post_queries import LEXICON, MONTHLY, ORDER, WINDOW_STATS, _vowel_scorer, lake_root
from agoralens.plans.registry import query, rounded
from agoralens.schema import POST_KEYS, POSTS
from agoralens.session import materialise, scratch_path
from agoralens.sources import fixtures, lake
from agoralens.streaming import ingest, scored as st

EVENTS = StructType(
    [
        StructField("event_id", LongType()),
        StructField("ts", TimestampNTZType()),
        StructField("user_id", LongType()),
        StructField("event_type", StringType()),
        StructField("value", DoubleType()),
        StructField("props", StringType()),
    ]
)
MICROSECONDS = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def post_stream(spark, sf_dir, max_files: int | None = None) -> DataFrame:
    path = lake.zone_path("bronze", "posts", lake_root(spark, sf_dir))
    return lake.stream_table(spark, path, POSTS, max_files=max_files)


def to_table(df: DataFrame) -> DataFrame:
    spark, root = df.sparkSession, scratch_path(df.sparkSession, "stream")
    st.run(ingest.append_to(df, f"{root}/table", f"{root}/checkpoint"))
    return spark.read.schema(df.schema).parquet(f"{root}/table")


def silver(spark, sf_dir, scorer=LEXICON, max_files: int | None = None, window: int | None = None) -> str:
    """Run the scoring stream over all posts; returns the silver root."""
    root = scratch_path(spark, "silver")
    posts = post_stream(spark, sf_dir, max_files)
    st.run(st.score_stream(posts, scorer, f"{root}/tables", f"{root}/checkpoint", window=window))
    return f"{root}/tables"


@query(f"with {sql.POSTS} select * from posts")
def stream_table(spark, sf_dir):
    return to_table(post_stream(spark, sf_dir, max_files=2))


def to_view(df: DataFrame) -> str:
    name, root = f"posts_{uuid.uuid4().hex}", scratch_path(df.sparkSession, "view")
    st.run(st.stream_to_view(df, name, f"{root}/table", f"{root}/checkpoint"))
    return name


@query(f"with {sql.POSTS} select post_id, enqueued_utc, thread, subreddit from posts")
def stream_to_memory(spark, sf_dir):
    """The named result of a stream, as the memory sink gives it, but held in files and not by the driver."""
    return spark.table(to_view(post_stream(spark, sf_dir).select(*ORDER, "thread", "subreddit")))


@query(f"with {sql.POSTS} select post_id, enqueued_utc, thread from posts order by enqueued_utc, post_id")
def stream_result(spark, sf_dir):
    return st.stream_result(spark, to_view(post_stream(spark, sf_dir).select(*ORDER, "thread")))


@query("select event_id, ts, user_id, event_type, value, props, cast(null as varchar) as _corrupt_record from events")
def ingest_json(spark, sf_dir):
    """Events as lines of JSON, streamed back into a typed table."""
    root = scratch_path(spark, "ingest")
    lines = fixtures.table(spark, sf_dir, "events").select(F.to_json(F.struct("*"), MICROSECONDS).alias("value"))
    lines.write.text(f"{root}/lines")
    stream = spark.readStream.text(f"{root}/lines")
    st.run(ingest.ingest_json(stream, EVENTS, f"{root}/bronze", f"{root}/checkpoint", options=MICROSECONDS))
    return spark.read.parquet(f"{root}/bronze").drop("processed_utc")


_ELIGIBLE = f"{sql.SCORED}, eligible as (select * from scored where token_count > 10)"


@query(f"with {_ELIGIBLE} select post_id, enqueued_utc, token_count, prediction, prediction_prob from eligible")
def write_silver(spark, sf_dir):
    rows = st.read_silver(spark, silver(spark, sf_dir, max_files=4), st.SCORED)
    return rounded(rows.select(*ORDER, "token_count", "prediction", "prediction_prob"), "prediction_prob")


@query(f"with {sql.POSTS} select post_id, enqueued_utc from posts where enqueued_utc >= timestamp '{sql.START_ENQUEUED}'")
def stream_since(spark, sf_dir):
    return to_table(since(post_stream(spark, sf_dir), "enqueued_utc", sql.START_ENQUEUED).select(*ORDER))


@query(f"with {_ELIGIBLE} select post_id, enqueued_utc, user_posting, token_count from eligible")
def stream_clean(spark, sf_dir):
    return to_table(st.eligible_posts(post_stream(spark, sf_dir)).select(*ORDER, "user_posting", "token_count"))


@query(f"with {_ELIGIBLE} select post_id, enqueued_utc, user_posting from eligible where prediction = 1")
def stream_positives(spark, sf_dir):
    root = silver(spark, sf_dir, max_files=4)
    return st.read_positives(spark, root).select(*ORDER, "user_posting")


@query(
    f"""with {_ELIGIBLE} select post_id, enqueued_utc from eligible
    where len(regexp_extract_all(user_posting, 'e')) * 10 > length(user_posting)"""
)
def stream_positives_batch_scorer(spark, sf_dir):
    """The stream with a scorer that is the caller's own function."""
    root = silver(spark, sf_dir, BatchScorer(_vowel_scorer), max_files=4)
    return st.read_positives(spark, root).select(*ORDER)


@query(f"with {sql.POSTS} select post_id, subreddit, enqueued_utc from posts")
def stream_append_sink(spark, sf_dir):
    return to_table(post_stream(spark, sf_dir, max_files=4).select(*ORDER, "subreddit"))


@query(f"with {_ELIGIBLE} {WINDOW_STATS.format('eligible')}")
def stream_count_windows(spark, sf_dir):
    """Runs of 1,000 eligible posts; here one micro-batch takes all files."""
    return st.read_windows(spark, silver(spark, sf_dir, window=1000))


@query(f"with {_ELIGIBLE} select window_no, posts, scored from ({WINDOW_STATS.format('eligible')})")
def stream_count_windows_batches(spark, sf_dir):
    """Runs of 1,000 posts across micro-batches of one file each: how many posts a window has doesn't depend on the order of files."""
    return st.read_windows(spark, silver(spark, sf_dir, max_files=1, window=1000)).select("window_no", "posts", "scored")


@query(f"with {_ELIGIBLE} select {MONTHLY} from eligible group by 1, 2")
def stream_monthly_stats(spark, sf_dir):
    return rounded(st.read_monthly(spark, silver(spark, sf_dir, max_files=4)), "avg_token_count")


# --- redeliveries, raw posts, summaries ----------------------------------------------


def deliveries(spark, sf_dir, run, parts: int = 3) -> None:
    """The posts in stretches of time, each delivered after the one before was streamed: `run` takes what is new."""
    posts = lake.read_table(spark, "bronze", "posts", root=lake_root(spark, sf_dir))
    path = f"{scratch_path(spark, 'deliveries')}/posts"
    part = F.ntile(parts).over(Window.orderBy("day"))
    day = F.to_date("enqueued_utc").alias("day")
    days = materialise(posts.groupBy(day).count().select("day", part.alias("part")))  # a row a day
    for k in range(1, parts + 1):
        posts.join(days.filter(F.col("part") == k), F.to_date("enqueued_utc") == F.col("day"), "left_semi").write.mode("append").parquet(path)
        run(lake.stream_table(spark, path, POSTS))


_KEYS = "post_id, subreddit, user_posting, author, post_date"


@query(f"with {sql.POSTS} select distinct {_KEYS} from posts")
def stream_dedup_posts(spark, sf_dir):
    """Each post once, though its redelivery comes a day later, in this or in a later micro-batch."""
    root = scratch_path(spark, "stream")
    deliveries(spark, sf_dir, lambda posts: st.run(ingest.append_to(st.drop_redeliveries(posts, "3 days"), f"{root}/table", f"{root}/checkpoint")))
    return spark.read.schema(POSTS).parquet(f"{root}/table").select(*POST_KEYS)


@query(
    f"""with {sql.SCORED}, firsts as (
      select *, row_number() over (partition by {_KEYS} order by enqueued_utc) as r from scored where token_count > 10
    ) select {MONTHLY} from firsts where r = 1 group by 1, 2"""
)
def stream_monthly_stats_dedup(spark, sf_dir):
    """The monthly report of the stream, equal to that of the batch without redeliveries."""
    root = scratch_path(spark, "silver")

    def run(posts: DataFrame) -> None:
        st.run(st.score_stream(posts, LEXICON, f"{root}/tables", f"{root}/checkpoint", window=None, dedup="3 days"))

    deliveries(spark, sf_dir, run)
    return rounded(st.read_monthly(spark, f"{root}/tables"), "avg_token_count")


_BROKEN = "select '{broken ' || doc_id as _corrupt_record from documents where doc_id % 50 = 0"


@query(
    f"""with {sql.POSTS} select post_id, subreddit, thread, user_posting, author, post_date, enqueued_utc, cast(null as varchar) as _corrupt_record from posts
    union all select null, null, null, null, null, null, null, _corrupt_record from ({_BROKEN})"""
)
def ingest_posts(spark, sf_dir):
    """Posts as lines of JSON under their raw names, with broken lines among them, streamed to the bronze table."""
    root = scratch_path(spark, "ingest")
    raw = fixtures.bronze_posts(spark, sf_dir).drop("EventProcessedUtcTime")
    lines = raw.select(F.to_json(F.struct("*"), MICROSECONDS).alias("value"))
    broken = fixtures.documents(spark, sf_dir).filter("doc_id % 50 = 0").select(F.concat(F.lit("{broken "), "doc_id").alias("value"))
    lines.union(broken).write.text(f"{root}/lines")
    st.run(ingest.ingest_json(spark.readStream.text(f"{root}/lines"), raw.schema, f"{root}/bronze", f"{root}/checkpoint", options=MICROSECONDS))
    return normalise_names(spark.read.parquet(f"{root}/bronze").drop("processed_utc"))


@query(f"with {sql.TOKENS_OF_POSTS} select token, count(*) as n, true as bounded from post_tokens group by token order by n desc, token limit 10")
def stream_frequent_tokens(spark, sf_dir):
    """The most frequent tokens of all posts, each with whether the summaries of the micro-batches hold its count between their bounds."""
    root = scratch_path(spark, "frequent")
    st.run(st.frequent_stream(post_stream(spark, sf_dir, max_files=2), f"{root}/tables", f"{root}/checkpoint"))
    found = sketches.merge_frequent(st.read_silver(spark, f"{root}/tables", st.FREQUENT_TOKENS))
    posts = lake.read_table(spark, "bronze", "posts", root=lake_root(spark, sf_dir))
    top = corpus.top_tokens(corpus.token_counts(posts, "user_posting"))
    bounded = F.coalesce(F.col("n").between(F.col("at_least"), F.col("at_most")), F.lit(False))
    return top.join(found, "token", "left").select("token", "n", bounded.alias("bounded"))
