"""Small files and folders through the file system that Spark uses for a path."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _at(spark, path)
    return fs.exists(at)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    at, fs = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def stamps(spark: SparkSession, path: str) -> tuple[tuple[str, int, int], ...]:
    """Name, length and time of change of a file, or of the files of a folder."""
    at, fs = _at(spark, path)
    return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(at)))


def read_text(spark: SparkSession, path: str) -> str:
    at, fs = _at(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def move_new(spark: SparkSession, source: str, target: str) -> bool:
    """Rename to a name that is free; false if it is taken. One of several callers wins."""
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(jvm.java.net.URI(jvm.org.apache.hadoop.fs.Path(target).toUri().toString()), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target), none)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    return True


def write_new(spark: SparkSession, path: str, text: str) -> bool:
    """A file that appears whole or not at all; false if its name is taken."""
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    at, fs = _at(spark, temporary)
    stream = fs.create(at, True)
    try:
        stream.write(text.encode())
    finally:
        stream.close()
    moved = move_new(spark, temporary, path)
    if not moved:
        fs.delete(at, False)
    return moved


def delete(spark: SparkSession, path: str) -> None:
    at, fs = _at(spark, path)
    fs.delete(at, True)
