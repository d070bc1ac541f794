"""Compare a query with its SQL, column by column, in any row order."""

from __future__ import annotations

import datetime as dt
import math
from pathlib import Path

import duckdb


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {file.stem} as select * from read_parquet('{file}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def differences(spark_df, con, sql: str) -> str | None:
    """None if both sides agree, else what differs first."""
    relation = con.sql(sql)
    theirs_columns, theirs_types = relation.columns, [str(t) for t in relation.types]
    if sorted(spark_df.columns) != sorted(theirs_columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(theirs_columns)}"
    same = {
        "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date",
        "TIMESTAMP": "timestamp_ntz", "VARCHAR[]": "array<string>", "BOOLEAN": "boolean",
    }
    types = dict(spark_df.dtypes)
    for name, theirs in zip(theirs_columns, theirs_types):
        if types[name] != same.get(theirs, theirs):
            return f"type of {name}: {types[name]} != {theirs}"
    ours, theirs = _rows(spark_df.columns, spark_df.collect()), _rows(theirs_columns, relation.fetchall())
    if len(ours) != len(theirs):
        return f"{len(ours)} rows != {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b:
            return f"{a!r} != {b!r}"[:600]
    return None
