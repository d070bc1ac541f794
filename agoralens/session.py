"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache, wraps
from pathlib import Path
from zipfile import ZipFile

from pyspark.sql import DataFrame, SparkSession

from agoralens.sources import files

CHECKPOINT_CONF = "spark.checkpoint.dir"


def use_utc(spark: SparkSession) -> SparkSession:
    """Month and day buckets must not depend on where the driver runs."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, as `--py-files` would."""
    _ship(spark.sparkContext.applicationId)
    return spark


@lru_cache
def _ship(application: str) -> None:
    package = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="agoralens-")) / "agoralens.zip"
    with ZipFile(archive, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    SparkSession.active().sparkContext.addPyFile(str(archive))


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read, taken from the session.

    A machine-local folder is created only on a local master, where there is
    a single machine; on a cluster a missing setting is an error.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="agoralens-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str, lasting: bool = False) -> str:
    """A fresh path below the shared folder; never reused, so never overwritten.

    It belongs to the scope it is made in, see `scratch_scope`, unless it is lasting.
    """
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}" + "-lasting" * lasting
    if not lasting and (scope := _scope.get()) is not None:
        scope.paths.append(path)
    return path


class Scope:
    """The scratch paths of a piece of work."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.read = spark, [], set()

    def keep(self, df: DataFrame) -> DataFrame:
        """What `df` reads outlasts the scope."""
        self.read |= set(input_files(df))
        return df

    def close(self) -> list[str]:
        """Delete the paths that no kept frame reads; returns the others."""
        kept = [p for p in self.paths if any(f"/{p.rsplit('/', 1)[1]}/" in f for f in self.read)]
        for path in set(self.paths) - set(kept):
            files.delete(self.spark, path)
        return kept


_scope: ContextVar[Scope | None] = ContextVar("scope", default=None)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[Scope]:
    """Scratch paths made inside are deleted at the end, but for those that a kept frame still reads.

    These pass to the scope around, if there is one; without one they stay until `release`.
    """
    outer, scope = _scope.get(), Scope(spark)
    token = _scope.set(scope)
    try:
        yield scope
    except BaseException:
        scope.read.clear()
        raise
    finally:
        _scope.reset(token)
        kept = scope.close()
        if outer is not None:
            outer.paths += kept


def scoped(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A function from a frame to a frame whose scratch ends with it, but for what its result reads."""

    @wraps(function)
    def call(df: DataFrame, *args, **named) -> DataFrame:
        with scratch_scope(df.sparkSession) as scope:
            return scope.keep(function(df, *args, **named))

    return call


def input_files(df: DataFrame) -> list[str]:
    """Files that a frame reads, in subqueries too."""
    dataset = df.sparkSession._jvm.org.apache.spark.sql.classic.Dataset
    inner = df._jdf.queryExecution().analyzed().subqueriesAll()
    plans = [dataset.ofRows(df._jdf.sparkSession(), inner.apply(k)) for k in range(inner.size())]
    return [*df.inputFiles(), *(f for d in plans for f in d.inputFiles())]


def release(df: DataFrame) -> None:
    """Delete the scratch folders that a frame reads, once it is written and done with. Lasting ones stay."""
    spark = df.sparkSession
    top = f"{shared_dir(spark).split(':', 1)[-1].rstrip('/')}/".replace("//", "/")
    found = {m[0] for f in input_files(df) if (m := re.match(rf".*?{re.escape(top)}[^/]+-[0-9a-f]{{32}}(?=/)", f))}
    for path in found:
        files.delete(spark, path)


def materialise(df: DataFrame, path: str | None = None, fmt: str = "parquet", **options: str) -> DataFrame:
    """Write a frame once and read it back.

    Used where a frame feeds several consumers (scores that must not be
    computed twice, lookup tables derived from a full scan). Unlike a cache it
    survives executor loss, and the file size gives the optimizer a real
    statistic, so a later join is broadcast only if the measured size allows.
    `options` are the writer's.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, "materialised")
    df.write.format(fmt).mode("overwrite").options(**options).save(path)
    return spark.read.format(fmt).schema(df.schema).load(path)
