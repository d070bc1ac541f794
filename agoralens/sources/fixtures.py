"""Relations of posts built from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from agoralens.operators.projections import normalise_names


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def bronze_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts under their raw column names, redeliveries included.

    Every document is a post; date and author come from the order, thread and
    arrival from the event of the same number. Each seventh post was delivered
    again a day later. The copies come from one pass (`explode`) instead of a
    union, which would scan and join twice.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    deliveries = F.when(F.col("doc_id") % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    enqueued = F.col("ts") + F.make_dt_interval(days=F.col("delivery"))
    return (
        docs.join(orders, F.col("doc_id") == F.col("o_orderkey"))
        .join(events, F.col("doc_id") == F.col("event_id"))
        .withColumn("delivery", F.explode(deliveries))
        .select(
            F.col("doc_id").alias("Post ID"),
            F.col("source").alias("Subreddit"),
            F.col("event_type").alias("Thread"),
            F.col("text").alias("User Posting"),
            F.col("o_custkey").alias("Author"),
            F.col("o_orderdate").alias("Post Date"),
            (enqueued + F.make_dt_interval(hours=F.lit(1))).alias("EventProcessedUtcTime"),
            enqueued.alias("EventEnqueuedUtcTime"),
        )
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise_names(bronze_posts(spark, sf_dir))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled texts (doc_id, text, label)."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return documents(spark, sf_dir).join(labels, "doc_id")


def with_split(corpus_rows: DataFrame) -> DataFrame:
    """Assign every row to train, val or test by its number."""
    last = F.col("doc_id") % 10
    return corpus_rows.withColumn("split", F.when(last < 8, "train").when(last == 8, "val").otherwise("test"))
