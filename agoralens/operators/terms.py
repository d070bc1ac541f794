"""Documents as sparse rows of terms, and the dictionary that numbers the terms.

A row's terms are counted inside the row, so nothing is shuffled by (document,
term). The dictionary is a table with dense numbers in the order of the terms.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from agoralens.functions.text import clean_terms, longer_than, without
from agoralens.operators.corpus import CLEAN_LONGER_THAN, MAX_DF, MIN_DF, STEM_LONGER_THAN, lemmatise, stem, within_bounds
from agoralens.operators.windows import count_window
from agoralens.session import materialise


def run_starts(ordered: Column, same) -> Column:
    """Where the runs of equal elements begin; `same` gives of an element what must be equal."""
    numbers = F.when(F.size(ordered) > 0, F.sequence(F.lit(0), F.size(ordered) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(numbers, lambda i: (i == 0) | (same(F.get(ordered, i)) != same(F.get(ordered, i - 1))))


def count_terms(df: DataFrame, terms: str, into: str = "counts") -> DataFrame:
    """The rows with `into`, an array of (term, tf) in the order of the terms, in place of the array `terms`.

    Counting sorts the row's own terms and measures the runs. A null array has no counts.
    """
    kept = [c for c in df.columns if c not in (terms, into)]
    sorted_ = df.select(*kept, F.array_sort(F.coalesce(F.col(terms), F.array().cast("array<string>"))).alias("_sorted"))
    runs = sorted_.select(*kept, "_sorted", run_starts(F.col("_sorted"), lambda x: x).alias("_starts"))

    def entry(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get("_starts", k + 1), F.size("_sorted"))
        return F.struct(F.get("_sorted", start).alias("term"), (end - start).alias("tf"))

    return runs.select(*kept, F.transform("_starts", entry).alias(into))


def clean_rows(df: DataFrame, stops: Iterable[str], text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, counts) of the clean terms of each document, stop words left out. Documents without any have an empty array."""
    kept = without(clean_terms(F.col(text), CLEAN_LONGER_THAN), stops)
    return count_terms(df.select(key, kept.alias("terms")), "terms")


def distinct_tokens(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("counts.term").alias("token")).distinct()


def stem_mapping(tokens: DataFrame, closure: DataFrame) -> DataFrame:
    """(token, term): the stem of the lemma of each distinct token; those that get too short are left out."""
    lemmas = lemmatise(tokens.withColumn("own", F.col("token")), closure)
    stems = lemmas.select(F.col("own").alias("token"), stem(F.col("token")).alias("term"))
    return stems.filter(longer_than(F.col("term"), STEM_LONGER_THAN))


def map_terms(rows: DataFrame, mapping: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, counts) with every token replaced by its term, counts of equal terms added up.

    The counted tokens are joined with the mapping and gathered by document; what
    a mapping made equal is added up inside the row. Tokens without a term, and
    documents without any term, are left out. `key` must tell rows apart.
    """
    tokens = rows.select(key, F.inline("counts").alias("token", "tf"))
    mapped = tokens.join(mapping, "token").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("term", "tf"))).alias("_all"))
    runs = mapped.select(key, "_all", run_starts(F.col("_all"), lambda x: x["term"]).alias("_starts"))

    def entry(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get("_starts", k + 1), F.size("_all"))
        total = F.aggregate(F.slice("_all", start + 1, end - start), F.lit(0), lambda n, x: n + x["tf"])
        return F.struct(F.get("_all", start)["term"].alias("term"), total.alias("tf"))

    return runs.select(key, F.transform("_starts", entry).alias("counts"))


def vocabulary_of(rows: DataFrame, documents: DataFrame, min_df: int = MIN_DF, max_df: float = MAX_DF) -> DataFrame:
    """(term, df) of the terms within the bounds; every row counts a term once."""
    frequency = rows.select(F.explode("counts.term").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return within_bounds(frequency, documents, min_df, max_df)


def dictionary(vocabulary: DataFrame) -> DataFrame:
    """The vocabulary with `id`: dense numbers in the order of the terms, without any task that sees all of them."""
    numbered = count_window(materialise(vocabulary), ["term"])
    return materialise(numbered.select(*vocabulary.columns, F.col("position").alias("id")))


def long_matrix(rows: DataFrame, vocabulary: DataFrame, key: str = "doc_id") -> DataFrame:
    """Long (key, term, tf) over the vocabulary. One too big to broadcast is joined by shuffle, where adaptive
    execution splits the partitions of very common terms."""
    return rows.select(key, F.inline("counts")).join(vocabulary.select("term"), "term", "left_semi").select(key, "term", "tf")


def vectors(rows: DataFrame, numbered: DataFrame, key: str = "doc_id") -> DataFrame:
    """One sparse row (key, ids, tfs) a document, ids ascending. Documents without a term of the dictionary are left out."""
    entries = rows.select(key, F.inline("counts")).join(numbered.select("term", "id"), "term")
    gathered = entries.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("id", "tf"))).alias("_row"))
    return gathered.select(key, F.col("_row.id").alias("ids"), F.col("_row.tf").alias("tfs"))


def term_matrix(df: DataFrame, stops: Iterable[str], text: str = "text", min_df: int = MIN_DF, max_df: float = MAX_DF) -> DataFrame:
    """Long (doc_id, term, tf) of the clean terms over their vocabulary. The texts are read once: the counts are
    written, and both the vocabulary and the matrix come from them."""
    rows = materialise(clean_rows(df, stops, text))
    return long_matrix(rows, materialise(vocabulary_of(rows, df, min_df, max_df)))
