"""JSON events to the bronze table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

CORRUPT = "_corrupt_record"


def parse_events(stream: DataFrame, schema: StructType, column: str = "value", options: dict | None = None) -> DataFrame:
    """Typed columns plus the processing time.

    A line that cannot be parsed is kept, as text in `_corrupt_record`: an
    ingest must not lose rows.
    """
    with_corrupt = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    event = F.from_json(F.col(column), with_corrupt, {**(options or {}), "columnNameOfCorruptRecord": CORRUPT})
    return stream.select(event.alias("event")).select(
        "event.*", F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).cast("timestamp_ntz").alias("processed_utc")
    )


def append_to(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", continuous: bool = False) -> StreamingQuery:
    """Append a stream to a table, exactly once, with a checkpoint.

    By default it takes what is there and stops; `continuous` keeps it running.
    """
    writer = df.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint)
    if not continuous:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)


def ingest_json(
    stream: DataFrame,
    schema: StructType,
    path: str,
    checkpoint: str,
    fmt: str = "parquet",
    options: dict | None = None,
) -> StreamingQuery:
    """Lines of JSON (files, or the value column of a broker) to bronze.

    `options` are JSON reader options, such as timestamp formats.
    """
    return append_to(parse_events(stream, schema, options=options), path, checkpoint, fmt)
