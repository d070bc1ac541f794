"""The scoring stream: the batch functions applied to each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from agoralens.functions.text import token_count
from agoralens.operators import reports, sketches
from agoralens.operators.corpus import token_counts
from agoralens.operators.filters import min_tokens, positives, since
from agoralens.operators.projections import with_clean_text
from agoralens.operators.scoring import score_posts
from agoralens.operators.windows import WINDOW_POSTS, count_window, merge_window_stats, window_stats
from agoralens.schema import MIN_TOKENS, POST_KEYS
from agoralens.sources import files
from agoralens.streaming import silver

# Tables the stream writes below its root.
SCORED = "scored_posts"
MONTHLY = "monthly_partials"
WINDOWS = "window_stats"
FREQUENT_TOKENS = "frequent_tokens"

#: Narrow rows of a range that a task numbers: a small batch doesn't pay for many ranges.
RANGE_ROWS = 50_000

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def eligible_posts(posts: DataFrame, start: str | None = None, n: int = MIN_TOKENS, counter=token_count) -> DataFrame:
    """Stateless part of the stream: time bound, cleaning, token threshold.

    The posts of a micro-batch get a row id after the cleaning, which the filter reads too. So the
    optimizer can't move the threshold, and with it a second cleaning, to before the shuffle that
    spreads them, into the one task that reads a file.
    """
    if start:
        posts = since(posts, "enqueued_utc", start)
    counted = with_clean_text(posts, counter)
    if counted.isStreaming:
        return min_tokens(counted, n)
    return min_tokens(counted.withColumn("_row", F.monotonically_increasing_id()), n).filter("_row >= 0").drop("_row")


def write_silver(
    scored: DataFrame, root: str, batch_id: int, fmt: str = "parquet", window: int | None = WINDOW_POSTS, query: str | None = None
) -> bool:
    """Scored rows and aggregates of one micro-batch, in a file format.

    All tables show the batch at once. A batch that is there already is left as
    it is, and false is returned without a call of the scorer: a restart neither
    loses nor doubles rows. The aggregates read the written scores: the scorer runs
    for the first write only. `query` tells streams on the same root apart; by
    default it is the only one that wrote to it.

    Windows go on across batches: rows are numbered by batch, then event time,
    then post. The manifest knows how many rows came before. A window that two
    batches share is a partial in each, merged by `read_windows`.
    """
    if fmt == "delta":
        raise ValueError("silver tables are folders of plain files; a format with a log of its own needs none of this")
    spark = scored.sparkSession
    held: list[DataFrame] = []

    def write(folder: str, start: int) -> int:
        def put(df: DataFrame, table: str) -> DataFrame:
            path = f"{root}/{table}/{folder}"
            df.withColumn("batch_id", F.lit(batch_id)).write.format(fmt).save(path)
            return spark.read.format(fmt).load(path).drop("batch_id")

        # A second attempt, after another writer, has the scores already.
        written = put(held[-1] if held else scored, SCORED)
        held.append(written)
        put(reports.monthly_partials(written), MONTHLY)
        rows = written.count()
        if window:
            columns = written.select("post_id", "enqueued_utc", "prediction")
            ranges = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + rows // RANGE_ROWS)
            numbered = count_window(columns, ["enqueued_utc", "post_id"], window, f"{root}/_window_work/{folder}", start, ranges)
            put(window_stats(numbered), WINDOWS)
            files.delete(spark, f"{root}/_window_work/{folder}")
        return rows

    merges = {t: m for t, m in _MERGES.items() if window or t != WINDOWS}
    shown = silver.append(spark, root, query, batch_id, list(merges), write)
    silver.compact(spark, root, merges, fmt)
    return shown


def _merge_monthly(partials: DataFrame) -> DataFrame:
    return reports.add_partials(partials).withColumn("batch_id", F.lit(None).cast("int"))


def _merge_windows(partials: DataFrame) -> DataFrame:
    return merge_window_stats(partials).withColumn("batch_id", F.lit(None).cast("int"))


#: What becomes of the rows of closed batches: scores stay, aggregates add up.
_MERGES = {SCORED: lambda rows: rows, MONTHLY: _merge_monthly, WINDOWS: _merge_windows}


def drop_redeliveries(posts: DataFrame, delay: str, time: str = "enqueued_utc", keys: list[str] = POST_KEYS) -> DataFrame:
    """The stream with one row per key, the first that arrives.

    The state holds a digest per key, and each until the watermark has passed
    it: redeliveries must come within `delay` of the first in event time, and rows
    that are later than `delay` behind the newest are dropped as late. Kept in
    RocksDB, so that it may outgrow an executor's heap.
    """
    posts.sparkSession.conf.set(STATE_STORE, ROCKSDB)
    digest = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("-")) for k in keys)), 256)
    # A watermark needs an instant; in which zone the time is read doesn't matter for how far apart two are.
    keyed = posts.withColumns({"_key": F.unhex(digest), "_time": F.col(time).cast("timestamp")}).withWatermark("_time", delay)
    return keyed.dropDuplicatesWithinWatermark(["_key"]).drop("_key", "_time")


def spread(batch: DataFrame) -> DataFrame:
    """The rows of a micro-batch in even shares for all cores, in more shares if it is read in more parts."""
    return batch.repartition(max(batch.sparkSession.sparkContext.defaultParallelism, batch.rdd.getNumPartitions()))


def score_stream(
    posts: DataFrame,
    scorer,
    root: str,
    checkpoint: str,
    start: str | None = None,
    n: int = MIN_TOKENS,
    window: int | None = WINDOW_POSTS,
    fmt: str = "parquet",
    counter=token_count,
    continuous: bool = False,
    dedup: str | None = None,
) -> StreamingQuery:
    """Score a stream of posts into silver tables, without redeliveries that come within `dedup` (such as "3 days").

    Scoring inside `foreachBatch` and filtering the written result is what
    keeps it at one call per eligible post: a filter on the scorer's output in
    the same plan would call it again. The posts of a batch are spread over all
    cores first: a batch may be one file, and a file one task.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        # The id that the checkpoint holds: the same after a restart, another with a new checkpoint.
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        posts = eligible_posts(spread(batch), start, n, counter)
        write_silver(score_posts(posts, scorer, n), root, batch_id, fmt, window, query)

    if dedup:
        posts = drop_redeliveries(posts, dedup)
    writer = posts.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    if not continuous:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_silver(spark: SparkSession, root: str, table: str, fmt: str = "parquet") -> DataFrame:
    """The rows of all batches that are shown; a reader sees whole batches. `batch_id` is null where aggregates of batches were added up."""
    return silver.read(spark, root, table, fmt)


def read_positives(spark: SparkSession, root: str, fmt: str = "parquet") -> DataFrame:
    return positives(read_silver(spark, root, SCORED, fmt))


def read_monthly(spark: SparkSession, root: str, fmt: str = "parquet") -> DataFrame:
    return reports.merge_partials(read_silver(spark, root, MONTHLY, fmt))


def read_windows(spark: SparkSession, root: str, fmt: str = "parquet") -> DataFrame:
    """Statistics of the count windows of all batches, one row a window."""
    return merge_window_stats(read_silver(spark, root, WINDOWS, fmt))


def frequent_stream(posts: DataFrame, root: str, checkpoint: str, keep: int = sketches.FREQUENT, text: str = "user_posting") -> StreamingQuery:
    """Keep a summary of the most frequent tokens of every micro-batch; `sketches.merge_frequent` bounds their counts over all."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId")

        def write(folder: str, start: int) -> int:
            summary = sketches.frequent_partial(token_counts(batch, text), keep)
            summary.withColumn("batch_id", F.lit(batch_id)).write.parquet(f"{root}/{FREQUENT_TOKENS}/{folder}")
            return 0

        silver.append(spark, root, query, batch_id, [FREQUENT_TOKENS], write)
        silver.compact(spark, root, {FREQUENT_TOKENS: lambda rows: rows}, "parquet")

    return posts.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# --- named results --------------------------------------------------------------


def stream_to_view(df: DataFrame, name: str, path: str, checkpoint: str) -> StreamingQuery:
    """Append to files, and show them under a name in the session. The driver holds no row."""
    query = df.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()
    df.sparkSession.read.schema(df.schema).parquet(path).createOrReplaceTempView(name)
    return query


# --- memory sink, for tests and demonstrations --------------------------------


def stream_to_memory(df: DataFrame, name: str) -> StreamingQuery:
    """Append to an in-memory table of the driver. Everything the stream emits
    ends up on the driver, so this is no sink for production."""
    return df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()


def stream_result(spark: SparkSession, name: str) -> DataFrame:
    """The rows of a named result in event-time order."""
    return spark.table(name).orderBy("enqueued_utc", "post_id")


def run(query: StreamingQuery) -> None:
    """Wait for an available-now query and raise what made it fail."""
    query.awaitTermination()
    error = query.exception()
    if error:
        raise error


