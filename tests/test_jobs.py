from pyspark.sql import functions as F

from agoralens.operators.projections import normalise_names
from agoralens.operators.scoring import BatchScorer, Lexicon
from agoralens.plans.jobs import score_bronze
from agoralens.schema import POSTS, RAW_NAMES
from agoralens.sources.lake import read_table, zone_path


def bronze(spark, root):
    """Twelve posts under their raw names, four of them delivered twice."""
    ids = spark.range(12).select(F.explode(F.when(F.col("id") < 4, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"), "id")
    at = F.lit("2024-03-01").cast("timestamp_ntz")
    values = {
        "post_id": F.col("id"),
        "subreddit": F.lit("a"),
        "thread": F.lit("t"),
        "user_posting": F.concat(F.lit("sad "), F.col("id"), F.repeat(F.lit(" word"), (F.col("id") + 4).cast("int"))),
        "author": F.lit(1).cast("long"),
        "post_date": at,
        "processed_utc": at,
        "enqueued_utc": at + F.make_dt_interval(days=F.col("copy")),
    }
    raw = ids.select(*[values[new].cast(POSTS[new].dataType).alias(old) for old, new in RAW_NAMES.items()])
    # Parquet takes the raw names as they are.
    raw.write.parquet(zone_path("bronze", "posts", root))
    assert normalise_names(raw).columns == POSTS.fieldNames()


def test_bronze_to_report(spark, tmp_path):
    root = str(tmp_path)
    bronze(spark, root)
    report = score_bronze(spark, root, Lexicon({"sad": 1.0})).first()
    # Posts 5 to 11 have more than ten tokens: "sad", the number, the words.
    assert (report.month, report.post_count, report.prediction_1) == ("2024-03", 16, 7)
    report = score_bronze(spark, root, Lexicon({"sad": 1.0}), gold="deduped", dedup=True).first()
    assert (report.post_count, report.prediction_1) == (12, 7)
    assert read_table(spark, "gold", "post_predictions", root=root).count() == 16


def test_report_does_not_call_the_scorer_again(spark, tmp_path):
    root = str(tmp_path)
    bronze(spark, root)
    calls = spark.sparkContext.accumulator(0)

    def make():
        def score(texts):
            calls.add(len(texts))
            return [(1, 0.5)] * len(texts)

        return score

    report = score_bronze(spark, root, BatchScorer(make), dedup=True)
    for _ in range(2):
        assert report.first().prediction_1 == 7
    assert calls.value == 7
