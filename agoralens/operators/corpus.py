"""Token frame, token cleaning, frequencies, vocabulary and term matrix.

The unit is the long frame (doc_id, pos, token). Reports that only need counts
count first (map-side, which takes the weight out of very frequent tokens) and
remove stop words, lemmatise and stem the distinct tokens afterwards.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import pyarrow as pa
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from agoralens.functions.text import (
    clean_terms,
    is_marked_word,
    join_tokens,
    longer_than,
    marked_tokens,
    normal_form,
    tokenize,
    unmarked,
    without,
)
from agoralens.session import materialise

# Shortest kept lengths are one above these; most frequent terms
# shown; terms in a word cloud; document-frequency bounds of a vocabulary;
# parts of speech in the order the lemmatiser tries them.
CLEAN_LONGER_THAN = 3
STEM_LONGER_THAN = 2
TOP_TERMS = 10
CLOUD_TERMS = 200
MIN_DF = 2
MAX_DF = 0.95
LEMMA_ORDER = ["v", "n", "a", "r"]

# Suffix rules of the default stemmer: (suffix, replacement), tried in order,
# each applied only where at least three letters remain.
STEM_RULES = [
    ("ciones", "cion"),
    ("mente", ""),
    ("ings?", ""),
    ("tions?", "t"),
    ("ments?", ""),
    ("ly", ""),
    ("e?s", ""),
    ("e", ""),
]


# --- token frame ------------------------------------------------------------


def flatten_tokens(df: DataFrame, text: str = "text", keys: Iterable[str] = ("doc_id",)) -> DataFrame:
    """One row per token, with its position in the document."""
    return df.select(*keys, F.posexplode(tokenize(F.col(text))).alias("pos", "token"))


def stop_words(spark: SparkSession, words: Iterable[str] | str = "spanish", fold: bool = False) -> DataFrame:
    """Stop words as a table: a language Spark ships a list for, or own words.

    With `fold` the words pass through the same normal form as the tokens;
    without it, words with accents never match a folded token. The table is
    made from an Arrow table, which gives the optimizer its size (a list of
    rows would not): a join broadcasts it while it is small.
    """
    if isinstance(words, str):
        words = StopWordsRemover.loadDefaultStopWords(words)
    table = spark.createDataFrame(pa.table({"token": pa.array(sorted(set(words)), pa.string())}))
    if fold:
        table = table.select(normal_form(F.col("token")).alias("token")).distinct()
    return table


def remove_stop_words(tokens: DataFrame, stops: DataFrame, token: str = "token") -> DataFrame:
    """Anti join. Spark broadcasts the list only while its size is small."""
    return tokens.join(stops.withColumnRenamed("token", token), token, "left_anti")


def clean_tokens(df: DataFrame, stops: DataFrame, text: str = "text", keys: Iterable[str] = ("doc_id",)) -> DataFrame:
    """The token frame in normal form: no stop words, letters only, more than
    three letters. Positions are those of the raw tokens.

    The costly steps run on the whole text; what is left per token is a test
    and the removal of a mark, which stay in generated code.
    """
    token = F.col("token")
    tokens = df.select(*keys, F.posexplode(marked_tokens(F.col(text))).alias("pos", "token"))
    letters = tokens.filter(is_marked_word(token, CLEAN_LONGER_THAN)).withColumn("token", unmarked(token))
    kept = letters.filter(longer_than(token, CLEAN_LONGER_THAN))
    return remove_stop_words(kept, stops).select(*tokens.columns)


# --- lemmas and stems -------------------------------------------------------


def lemma_closure(dictionary: DataFrame, order: Iterable[str] = LEMMA_ORDER) -> DataFrame:
    """Fold the passes over the parts of speech into one mapping.

    `dictionary` is (token, pos, lemma). Each pass looks up the result of the
    one before. Composing the passes on the dictionary leaves a single join
    for the corpus instead of one per pass.
    """
    closure = dictionary.select("token").distinct().withColumn("lemma", F.col("token"))
    for pos in order:
        one = dictionary.filter(F.col("pos") == pos).groupBy("token").agg(F.min("lemma").alias("_next"))
        closure = (
            closure.join(one.withColumnRenamed("token", "_from"), F.col("lemma") == F.col("_from"), "left")
            .select("token", F.coalesce("_next", "lemma").alias("lemma"))
        )
    return closure


def lemmatise(tokens: DataFrame, closure: DataFrame) -> DataFrame:
    """Replace tokens by their lemma; unknown tokens stay."""
    joined = tokens.join(closure, "token", "left")
    return joined.withColumn("token", F.coalesce("lemma", "token")).select(*tokens.columns)


def stem(token: Column, rules: Iterable[tuple[str, str]] = STEM_RULES) -> Column:
    return reduce(lambda c, rule: F.regexp_replace(c, rf"^(.{{3,}}?){rule[0]}$", rf"$1{rule[1]}"), rules, token)


def stem_tokens(tokens: DataFrame, rules: Iterable[tuple[str, str]] = STEM_RULES) -> DataFrame:
    """Stem, then keep tokens of more than two letters."""
    stemmed = tokens.withColumn("token", stem(F.col("token"), rules))
    return stemmed.filter(longer_than(F.col("token"), STEM_LONGER_THAN))


def clean_joined_text(df: DataFrame, stops: Iterable[str], text: str = "text", key: str = "doc_id") -> DataFrame:
    """The clean tokens of each document joined to one text.

    Tokens never leave their row, so nothing is shuffled. Documents without
    clean tokens are left out.
    """
    kept = without(clean_terms(F.col(text), CLEAN_LONGER_THAN), stops)
    return df.select(key, kept.alias("_kept")).filter(F.size("_kept") > 0).select(key, join_tokens(F.col("_kept")).alias("text"))


# --- frequencies ------------------------------------------------------------


def token_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(token, n) over the whole corpus."""
    tokens = df.select(F.explode(tokenize(F.col(text))).alias("token"))
    return tokens.groupBy("token").agg(F.count("*").alias("n"))


def clean_counts(df: DataFrame, stops: DataFrame, text: str = "text") -> DataFrame:
    """(token, n) of the clean tokens. Stop words leave after counting, where
    each is one row instead of a large part of the corpus."""
    tokens = df.select(F.explode(clean_terms(F.col(text), CLEAN_LONGER_THAN)).alias("token"))
    return remove_stop_words(tokens.groupBy("token").agg(F.count("*").alias("n")), stops)


def merge_counts(counts: DataFrame) -> DataFrame:
    """Add up counts of tokens that a token function has made equal."""
    return counts.groupBy("token").agg(F.sum("n").alias("n"))


def top_tokens(counts: DataFrame, k: int = TOP_TERMS) -> DataFrame:
    return counts.orderBy(F.desc("n"), "token").limit(k)


def corpus_sizes(counts: DataFrame) -> DataFrame:
    return counts.agg(F.sum("n").alias("tokens"), F.count("*").alias("distinct_tokens"))


def term_weights(counts: DataFrame, k: int = CLOUD_TERMS) -> DataFrame:
    """Top terms with their count relative to the most frequent one."""
    top = top_tokens(counts, k)
    # The window has no partition: it only ever sees the k rows of the report.
    everything = Window.partitionBy()
    return top.withColumn("weight", F.col("n") / F.max("n").over(everything))


# --- vocabulary and term matrix ---------------------------------------------


def document_frequency(df: DataFrame, stops: DataFrame, text: str = "text") -> DataFrame:
    """(term, df): in how many documents a clean term occurs.

    Repeats within a document are removed inside the row, so the only shuffle
    carries partial counts per term and needs no distinct on (term, document).
    """
    terms = F.array_distinct(clean_terms(F.col(text), CLEAN_LONGER_THAN))
    per_term = df.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return remove_stop_words(per_term, stops, "term")


def within_bounds(frequency: DataFrame, documents: DataFrame, min_df: int = MIN_DF, max_df: float = MAX_DF) -> DataFrame:
    """Terms in at least `min_df` documents and at most a share `max_df` of them."""
    total = documents.agg(F.count("*")).scalar()
    return frequency.filter((F.col("df") >= min_df) & (F.col("df") <= max_df * total))


def vocabulary(df: DataFrame, stops: DataFrame, text: str = "text", min_df: int = MIN_DF, max_df: float = MAX_DF) -> DataFrame:
    return within_bounds(document_frequency(df, stops, text), df, min_df, max_df)
