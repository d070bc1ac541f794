"""Cleaning and packing of documents, one operator a stage.

Every stage takes the documents that its predecessor kept; all but the last
return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from agoralens.llm import decontaminate, divergence, line_templates, lsh_forest, packing
from agoralens.llm.common import table
from agoralens.llm.queries import tokenizer_file
from agoralens.session import materialise, scoped, scratch_path, use_utc

#: No SQL: packing and edit distance aren't expressed in it. Tests hold each stage against a plain version.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return divergence.kept(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; n_chars follows the text. None is dropped."""
    out = line_templates.drop_recurring_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each group of near-duplicates; a null id comes last. Rows are numbered, so ids may be null or repeated."""
    rows = materialise(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("doc")), compression="zstd")
    gone = _rows_to_drop(rows)
    # Only rows that a filter of a bounded size doesn't clear are shuffled. An anti-join would be moved below the filter.
    known = lsh_forest.marked(rows, gone, "row")
    unsure = known.filter("_asked").join(gone.withColumn("gone", F.lit(True)).hint("merge"), "row", "left").filter("gone is null")
    return known.filter("not _asked").select("doc.*").union(unsure.select("doc.*"))


@scoped
def _rows_to_drop(rows: DataFrame) -> DataFrame:
    """The rows of each group of near-duplicates but the one that stays, written; what led to them is gone at the end."""
    groups = lsh_forest.near_duplicates(rows.select(F.col("row").alias("doc_id"), "doc.text"), n=5, percent=80)
    member = groups.select(F.col("doc_id").alias("row"), "component_id")
    ids = rows.select("row", F.col("doc.doc_id").isNull().alias("last"), F.col("doc.doc_id").alias("id"))
    member = materialise(member.join(ids, "row"))
    first = member.groupBy("component_id").agg(F.min(F.struct("last", "id", "row")).alias("first"))
    return materialise(member.join(first.select("component_id", F.col("first.row").alias("first")), "component_id").filter("row <> first").select("row"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences of 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each but the last is written and read again."""
    use_utc(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(path := scratch_path(spark, f"stage-{k}"))
            docs = spark.read.parquet(path)
    return docs
