"""Tables of the lake: three zones of stored tables, plus the session catalog."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

# The zones, and the setting that holds the root of the lake.
ZONES = ("bronze", "silver", "gold")
ROOT_CONF = "spark.agoralens.lake.root"


def zone_path(zone: str, name: str, root: str) -> str:
    """Path of a table. Credentials belong in `spark.hadoop.*` settings."""
    if zone not in ZONES:
        raise ValueError(f"unknown zone {zone!r}; one of {', '.join(ZONES)}")
    return f"{root.rstrip('/')}/{zone}/{name}"


def read_table(spark: SparkSession, zone: str, name: str, fmt: str = "parquet", root: str | None = None) -> DataFrame:
    """A stored table; `fmt` may be any installed format, such as delta."""
    return spark.read.format(fmt).load(zone_path(zone, name, root or spark.conf.get(ROOT_CONF)))


def read_splits(spark: SparkSession, splits: dict[str, str], fmt: str = "parquet") -> DataFrame:
    """The splits of a corpus as one bag of rows with a `split` column."""
    parts = [spark.read.format(fmt).load(path).withColumn("split", F.lit(name)) for name, path in splits.items()]
    return union_splits(*parts)


def union_splits(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def write_gold(df: DataFrame, path: str, fmt: str = "parquet", partition_by: str | None = None) -> DataFrame:
    """Overwrite a scored table and read it back.

    Reading back is what makes every later use see the written scores instead
    of calling the scorer again. With `partition_by` the rows are rebalanced
    first: adaptive execution then writes files of a sensible size and splits
    a partition that holds much of the data.
    """
    writer = df.write
    if partition_by:
        writer = df.hint("rebalance", partition_by).write.partitionBy(partition_by)
    writer.format(fmt).mode("overwrite").save(path)
    return df.sparkSession.read.format(fmt).load(path)


def profile_schema(df: DataFrame) -> DataFrame:
    """Name, type and non-null count of every column, in one pass."""
    types = dict(df.dtypes)
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    rows = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(c).alias("column_name"),
            F.lit(types[c]).alias("data_type"),
            F.col(f"`{c}`").alias("non_null"),
        )
        for i, c in enumerate(df.columns)
    ]
    return counts.select(F.inline(F.array(*rows)))


def preview(df: DataFrame, keys: list[str], n: int = 20) -> DataFrame:
    """The first rows by key: a top-n, not a full sort."""
    return df.orderBy(*keys).limit(n)


# --- catalog ----------------------------------------------------------------


def quoted(name: str) -> str:
    """A dotted name with every part in quotes."""
    return ".".join("`" + part.replace("`", "``") + "`" for part in name.split("."))


def create_schema(spark: SparkSession, name: str, location: str | None = None) -> None:
    where = " LOCATION '" + location.replace("\\", "\\\\").replace("'", "\\'") + "'" if location else ""
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {quoted(name)}{where}")


def publish_table(df: DataFrame, name: str, fmt: str = "parquet") -> DataFrame:
    """Overwrite a managed table, for tools that read the catalog."""
    df.write.format(fmt).mode("overwrite").saveAsTable(quoted(name))
    return df.sparkSession.table(quoted(name))


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {quoted(name)}")


# --- streams ----------------------------------------------------------------


def stream_table(
    spark: SparkSession,
    path: str,
    schema: StructType | None = None,
    fmt: str = "parquet",
    max_files: int | None = None,
) -> DataFrame:
    """A stored table as a stream; micro-batches are bounded by files.

    Plain files need the schema; a format with a table log has its own.
    """
    reader = spark.readStream.format(fmt)
    if schema:
        reader = reader.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)
