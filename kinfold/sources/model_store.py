"""Stored models: fitted pipelines with their preprocessing, by tag and time.

A version is a folder ``models/<tag>/<time in ms>`` below the shared folder; its
record (tag, time, columns that the preprocessing reads, the preprocessing
itself as JSON) is written after the model, so a version without a record is not
one. The newest record of a tag is the model that scores.
"""

from __future__ import annotations

import json
import time

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from ..session import ensure_checkpoint_dir


class NoModel(LookupError):
    """There is no stored model of a tag."""


class ColumnsChanged(ValueError):
    """The rows lack columns that a stored model was fitted on."""


def _root(spark: SparkSession, tag: str, base: str | None) -> str:
    if not tag or "/" in tag:
        raise ValueError(f"not a tag: {tag!r}")
    return f"{(base or ensure_checkpoint_dir(spark)).rstrip('/')}/models/{tag}"


def save(spark: SparkSession, tag: str, model: PipelineModel, prep: dict, base: str | None = None) -> str:
    """Store a version and return its folder."""
    path = f"{_root(spark, tag, base)}/{time.time_ns() // 1_000_000}"
    model.write().save(f"{path}/model")
    record = {"tag": tag, "columns": sorted(prep["columns"]), "prep": json.dumps(prep)}  # the order of the columns is that of the features
    spark.createDataFrame([(record["tag"], record["columns"], record["prep"])], "tag string, columns array<string>, prep string") \
        .coalesce(1).write.json(f"{path}/record")
    return path


def versions(spark: SparkSession, tag: str, base: str | None = None) -> list[str]:
    """Folders of the tag's versions, oldest first."""
    jvm, hadoop = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(_root(spark, tag, base))
    fs = at.getFileSystem(hadoop)
    if not fs.exists(at):
        return []
    done = [s.getPath() for s in fs.listStatus(at) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "record/_SUCCESS"))]
    return [p.toString() for p in sorted(done, key=lambda p: int(p.getName()))]


def newest(spark: SparkSession, tag: str, columns: list[str] | None = None, base: str | None = None) -> tuple[PipelineModel, dict]:
    """The newest model of a tag and its preprocessing. ``columns`` are those of
    the rows to score; without one that the model needs there is a clear error."""
    found = versions(spark, tag, base)
    if not found:
        raise NoModel(f"no stored model of tag {tag!r} in {_root(spark, tag, base)}")
    record = spark.read.json(f"{found[-1]}/record").first()
    missing = sorted(set(record["columns"]) - set(columns if columns is not None else record["columns"]))
    if missing:
        raise ColumnsChanged(f"the rows lack {', '.join(missing)}, which model {tag!r} was fitted on")
    return PipelineModel.load(f"{found[-1]}/model"), json.loads(record["prep"])
