"""Fitted pipelines, stored by version and loaded once a session."""

from __future__ import annotations

import uuid
from functools import lru_cache

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from agoralens.sources import files


def _folder(root: str, name: str, version: int) -> str:
    return f"{root}/{name}/v{version:06d}"


def versions(spark: SparkSession, root: str, name: str) -> list[int]:
    return [int(n[1:]) for n in files.names(spark, f"{root}/{name}") if n[:1] == "v" and n[1:].isdigit()]


def save_model(model: PipelineModel, root: str, name: str) -> int:
    """Store as the next version and return its number.

    A version appears whole, by a rename, and is never written again; of two
    writers that aim at the same number the second takes the next.
    """
    spark = SparkSession.active()
    temporary = f"{root}/{name}/_{uuid.uuid4().hex}"
    model.write().save(temporary)
    version = max(versions(spark, root, name), default=0) + 1
    while not files.move_new(spark, temporary, _folder(root, name, version)):
        version += 1
    return version


@lru_cache(maxsize=16)
def _loaded(application: str, folder: str) -> PipelineModel:
    return PipelineModel.load(folder)


def load_model(spark: SparkSession, root: str, name: str, version: int | None = None) -> PipelineModel:
    """A version, by default the newest. Versions don't change, so a session loads each once."""
    if version is None:
        stored = versions(spark, root, name)
        if not stored:
            raise FileNotFoundError(f"no version of {name} in {root}")
        version = stored[-1]
    return _loaded(spark.sparkContext.applicationId, _folder(root, name, version))
