"""Shared intermediate tables, written once so that plans over them stay short."""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[tuple, DataFrame] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only in a local session without that setting."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def grow(first: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of ``first``, ``step(first)``, ``step`` of that and so on until a level is empty.

    Each level is written once and read by the next, so no level is computed again and plans stay
    short whatever the depth.
    """
    spark, root, level = first.sparkSession, f"{shared_dir(first.sparkSession)}/levels-{uuid.uuid4().hex}", first
    for k in itertools.count():
        level.write.parquet(f"{root}/{k}")
        level = spark.read.schema(first.schema).parquet(f"{root}/{k}")
        if level.isEmpty():
            return spark.read.schema(first.schema).parquet(*(f"{root}/{i}" for i in range(k + 1)))
        level = step(level)


def shared(make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A table made from (spark, folder, ...) that is written on first use and reread by every query of the session.

    It is made anew in another session, for another folder and after ``forget``, which must be called when the
    input tables of a folder have changed.
    """

    def get(spark: SparkSession, sf_dir: str, *args) -> DataFrame:
        key = spark.sparkContext.applicationId, sf_dir, make.__module__, make.__name__, args
        if key not in _WRITTEN:
            frame, path = make(spark, sf_dir, *args), f"{shared_dir(spark)}/shared-{uuid.uuid4().hex}"
            frame.write.parquet(path)
            _WRITTEN[key] = spark.read.schema(frame.schema).parquet(path)
        return _WRITTEN[key]

    return get


def forget() -> None:
    """Make the next use of every shared table write it anew."""
    _WRITTEN.clear()
