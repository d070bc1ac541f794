"""Column names and types of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Raw column names of the bronze table and the names used here.
RAW_NAMES = {
    "Post ID": "post_id",
    "Subreddit": "subreddit",
    "Thread": "thread",
    "User Posting": "user_posting",
    "Author": "author",
    "Post Date": "post_date",
    "EventProcessedUtcTime": "processed_utc",
    "EventEnqueuedUtcTime": "enqueued_utc",
}

# A post is the same post when these five columns are equal.
POST_KEYS = ["post_id", "subreddit", "user_posting", "author", "post_date"]

# Columns of a scored (gold) table, in order.
GOLD_COLUMNS = [
    "subreddit",
    "thread",
    "author",
    "post_date",
    "user_posting",
    "token_count",
    "prediction",
    "prediction_prob",
]

# Posts as they arrive. Timestamps carry no zone: the lake stores UTC.
POSTS = T.StructType(
    [
        T.StructField("post_id", T.LongType()),
        T.StructField("subreddit", T.StringType()),
        T.StructField("thread", T.StringType()),
        T.StructField("user_posting", T.StringType()),
        T.StructField("author", T.LongType()),
        T.StructField("post_date", T.TimestampNTZType()),
        T.StructField("processed_utc", T.TimestampNTZType()),
        T.StructField("enqueued_utc", T.TimestampNTZType()),
    ]
)

SCORE = T.StructType(
    [
        T.StructField("prediction", T.IntegerType()),
        T.StructField("prediction_prob", T.DoubleType()),
    ]
)

# Score of a post whose scorer failed, and the token threshold
# a post must exceed to be scored at all.
ERROR_PREDICTION = -1
ERROR_PROBABILITY = 0.0
MIN_TOKENS = 10
