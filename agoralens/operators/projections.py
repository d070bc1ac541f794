"""Renames and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from agoralens.functions.text import clean_text, token_count
from agoralens.schema import GOLD_COLUMNS, RAW_NAMES


def normalise_names(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(RAW_NAMES)


def with_clean_text(df: DataFrame, counter=token_count) -> DataFrame:
    """Clean the post and count its tokens, the same for batch and stream."""
    text = clean_text(F.col("user_posting"))
    return df.withColumn("user_posting", text).withColumn("token_count", counter(F.col("user_posting")))


def with_score_fields(df: DataFrame, score: str = "model_output") -> DataFrame:
    """Lift the fields of a score struct into columns."""
    return df.withColumns(
        {
            "prediction": F.col(f"{score}.prediction"),
            "prediction_prob": F.col(f"{score}.prediction_prob"),
        }
    ).drop(score)


def select_gold(df: DataFrame) -> DataFrame:
    return df.select(*GOLD_COLUMNS)


def guarded(condition: Column, value: Column) -> Column:
    """Value where the condition holds, null elsewhere. Guards cheap built-in
    expressions; for scorers use `score_posts`, which guards the call itself."""
    return F.when(condition, value)


def as_category(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.col(column).cast("string"))


def with_doc_key(df: DataFrame, *columns: str) -> DataFrame:
    """A key made from the row's own columns instead of a row position.

    Positions need a total order over the data set; a content key is computed
    row by row and is the same on every run. A null is told apart from an
    empty text.
    """
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return df.withColumn("doc_key", F.sha2(F.concat_ws("\x1f", *parts), 256))
