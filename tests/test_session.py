"""Scratch that ends, stored models, files."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from agoralens.operators import models
from agoralens.operators.projections import with_clean_text
from agoralens.operators.scoring import score_posts, train_scorer
from agoralens.session import input_files, materialise, release, scratch_path, scratch_scope, shared_dir
from agoralens.sources import files

SF_DIR = "/root/testdata/sf0.001"


def shared(spark):
    return {p.name for p in Path(shared_dir(spark).removeprefix("file:")).iterdir()}


def test_scope_leaves_what_the_result_reads(spark):
    before = shared(spark)
    with scratch_scope(spark) as scope:
        a = materialise(spark.range(10))
        b = materialise(a.filter("id > 3"))
        result = scope.keep(b.filter("id > 5"))
    assert len(shared(spark) - before) == 1 and result.count() == 4
    release(result)
    assert shared(spark) == before


def test_scope_keeps_what_a_subquery_reads(spark):
    with scratch_scope(spark) as scope:
        a, b = materialise(spark.range(10)), materialise(spark.range(5))
        result = scope.keep(a.filter(F.col("id") < b.agg(F.count("*")).scalar()))
    assert result.count() == 5
    release(result)


def test_lasting_paths_outlast_scopes_and_release(spark):
    with scratch_scope(spark) as scope:
        df = scope.keep(materialise(spark.range(3), scratch_path(spark, "lake", lasting=True)))
    release(df)
    assert df.count() == 3


def test_inner_scope_hands_on(spark):
    before = shared(spark)
    with scratch_scope(spark):
        with scratch_scope(spark) as inner:
            materialise(spark.range(3))
            kept = inner.keep(materialise(spark.range(4)))
        assert len(shared(spark) - before) == 1 and kept.count() == 4
    assert shared(spark) == before


def test_scope_clears_up_after_an_error(spark):
    before = shared(spark)
    with pytest.raises(RuntimeError):
        with scratch_scope(spark) as scope:
            scope.keep(materialise(spark.range(3)))
            raise RuntimeError
    assert shared(spark) == before


@pytest.mark.parametrize("name", ["topics", "iqr_outliers", "lemmatise", "count_window_scored", "stream_monthly_stats", "term_matrix", "percentage"])
def test_query_leaves_only_what_its_result_reads(spark, name):
    entry.queries()[name](spark, SF_DIR).count()  # makes what lasts
    before = shared(spark)
    df = entry.queries()[name](spark, SF_DIR)
    left, read = shared(spark) - before, input_files(df)
    assert all(any(f"/{p}/" in f for f in read) for p in left)
    assert df.count() > 0
    release(df)
    assert shared(spark) == before


def test_models_are_versions_that_reload(spark, tmp_path):
    root = str(tmp_path)
    texts = [("good fine " + "word " * 12, 0), ("awful gloom " + "word " * 12, 1)] * 20
    labelled = spark.createDataFrame(texts, "text string, label int")
    model = train_scorer(labelled, features=1 << 10)
    assert models.save_model(model, root, "m") == 1
    assert models.save_model(train_scorer(labelled.withColumn("label", 1 - F.col("label")), features=1 << 10), root, "m") == 2
    assert models.versions(spark, root, "m") == [1, 2] and models.versions(spark, root, "other") == []
    posts = with_clean_text(spark.createDataFrame([(k, t) for k, (t, _) in enumerate(texts)], "post_id long, user_posting string"))

    def scores(m):
        return sorted((r.post_id, r.prediction, r.prediction_prob) for r in score_posts(posts, m).collect())

    first = models.load_model(spark, root, "m", 1)
    assert scores(first) == scores(model) and models.load_model(spark, root, "m", 1) is first
    assert [1 - p for _, p, _ in scores(models.load_model(spark, root, "m"))] == [p for _, p, _ in scores(model)]
    with pytest.raises(FileNotFoundError):
        models.load_model(spark, root, "other")


def test_write_new_takes_a_free_name_once(spark, tmp_path):
    path = str(tmp_path / "a" / "x")
    assert files.write_new(spark, path, "first") and not files.write_new(spark, path, "second")
    assert files.read_text(spark, path) == "first" and files.names(spark, str(tmp_path / "a")) in (["x"], [".x.crc", "x"])


def test_changed_tables_are_read_again(spark, tmp_path):
    from agoralens.plans.post_queries import lake_root
    from agoralens.sources import fixtures, lake

    for t in ("documents", "orders", "events"):
        fixtures.table(spark, SF_DIR, t).write.parquet(str(tmp_path / f"{t}.parquet"))
    first = lake_root(spark, str(tmp_path))
    assert lake_root(spark, str(tmp_path)) == first
    fixtures.table(spark, SF_DIR, "documents").limit(5).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    second = lake_root(spark, str(tmp_path))
    assert second != first and lake.read_table(spark, "bronze", "posts", root=second).select("post_id").distinct().count() == 5
