import pytest
from pyspark.sql import functions as F

from agoralens import session
from agoralens.sources import lake


def test_zone_path():
    assert lake.zone_path("gold", "posts", "s3://x/") == "s3://x/gold/posts"
    with pytest.raises(ValueError):
        lake.zone_path("copper", "posts", "s3://x")


def test_root_from_session(spark, tmp_path):
    spark.range(3).write.parquet(lake.zone_path("bronze", "t", str(tmp_path)))
    spark.conf.set(lake.ROOT_CONF, str(tmp_path))
    assert lake.read_table(spark, "bronze", "t").count() == 3


def test_splits_are_a_bag(spark, tmp_path):
    for name in ("train", "val"):
        spark.createDataFrame([("same", 1)], "text string, label int").write.parquet(str(tmp_path / name))
    rows = lake.read_splits(spark, {n: str(tmp_path / n) for n in ("train", "val")}).collect()
    assert sorted(tuple(r) for r in rows) == [("same", 1, "train"), ("same", 1, "val")]


def test_gold_overwrites_and_partitions(spark, tmp_path):
    path = str(tmp_path / "gold")
    for n in (10, 4):
        df = spark.range(n).withColumn("month", F.when(F.col("id") < 3, "2024-01").otherwise("2024-02"))
        written = lake.write_gold(df, path, partition_by="month")
    assert written.count() == 4
    assert {p.name for p in (tmp_path / "gold").iterdir() if p.is_dir()} == {"month=2024-01", "month=2024-02"}


def test_profile_counts_nulls_and_odd_names(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "`Post ID` long, `a.b` string")
    rows = [tuple(r) for r in lake.profile_schema(df).orderBy("position").collect()]
    assert rows == [(0, "Post ID", "bigint", 2), (1, "a.b", "string", 1)]


def test_catalog(spark, tmp_path):
    lake.create_schema(spark, "s1", str(tmp_path / "s1"))
    lake.create_schema(spark, "s1")
    lake.publish_table(spark.range(5), "s1.t")
    assert lake.publish_table(spark.range(2), "s1.t").count() == 2
    lake.drop_table(spark, "s1.t")
    lake.drop_table(spark, "s1.t")
    assert not spark.catalog.tableExists("s1.t")


def test_materialise_cuts_the_plan(spark, plan_of):
    df = session.materialise(spark.range(10).withColumn("x", F.rand()))
    assert "rand" not in plan_of(df)
    assert df.exceptAll(df).count() == 0


def test_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        session.shared_dir(Session())


def test_catalog_names_are_quoted(spark, tmp_path):
    schema = "2024_select"
    lake.create_schema(spark, schema, str(tmp_path / "it's here"))
    assert lake.publish_table(spark.range(3), f"{schema}.from").count() == 3
    lake.drop_table(spark, f"{schema}.from")
    assert spark.sql(f"SHOW TABLES IN {lake.quoted(schema)}").count() == 0
    spark.sql(f"DROP SCHEMA {lake.quoted(schema)} CASCADE")
