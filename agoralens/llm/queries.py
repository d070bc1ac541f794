"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from agoralens.llm import decontaminate, divergence, factorisation, language_crf, licenses, line_templates as lines, lsh_forest, merkle, onebit, packing, repair, reversed_search, sql, url_templates as urls
from agoralens.llm.common import table
from agoralens.session import scratch_path, use_utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer_file(name: str) -> str:
    """Content of a public tokenizer's file; it is read on the driver and sent to the workers."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_text()


def query(oracle: str | None = None):
    def register(function):
        def call(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(use_utc(spark), sf_dir)

        QUERIES[function.__name__] = call
        if oracle:
            ORACLES[function.__name__] = oracle
        return function

    return register


# The rules of op9, (verdict, host and path).
URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def fold(n: int) -> Column:
    """Remainder of the id's checksum, which parts what may be learned from the rest."""
    return F.crc32(F.col("doc_id").cast("string")) % n


@query()
def op1_factorisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = factorisation.train(docs, labels.filter(fold(3) != 1).select("doc_id", F.col("quality").alias("label")))
    held_out = F.coalesce(fold(3) == 1, F.lit(False))
    return factorisation.score(docs, machine).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query()
def op2_patience_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query()
def op3_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op5_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = language_crf.train(docs.filter(fold(4) != 2))
    held_out = F.coalesce(fold(4) == 2, F.lit(False))
    return language_crf.predict(docs, field).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query()
def op4_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.judge(table(spark, sf_dir, "documents"))


@query(sql.line_dedup(lines.LEAST_WORDS, lines.LEADING, lines.VARIANTS, lines.AGREE))
def op8_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(sql.url_filter(URL_RULES, 4, urls.CHILDREN, urls.LEAST, urls.STRENGTH, urls.ALIKE, urls.PURITY))
def op9_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


@query(sql.near_duplicates(2, 80))
def op6_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_duplicates(table(spark, sf_dir, "documents"), n=2, percent=80)


@query()
def op7_repair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "ids")
    repair.write_ids(table(spark, sf_dir, "documents"), path, tokenizer_file("word_bpe_49k.json"), end_id=2, base=49_408)
    return repair.decode(repair.read_blocks(spark, path))


@query()
def op10_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


@query(sql.ranked_search(10))
def op11_reversed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reversed_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


@query(sql.merkle_manifest(merkle.ARITY, levels=10, group_levels=4))
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    def leaf(text: Column) -> Column:
        return merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)

    text = F.col("text")
    tampered = F.when(fold(2) == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", leaf(text).alias("leaf"), leaf(tampered).alias("tampered"))
    checked = merkle.verified(merkle.manifest(rows), leaf="tampered")
    return checked.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("witness")).alias("proof_sha256"), "folded_root", "verified")


@query()
def op13_onebit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return onebit.neighbours(vectors, F.col("vec_id") % 100 == 0, k=10)
