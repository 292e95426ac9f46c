"""Reading tables and writing intermediate tables in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only in a local session without that setting."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


class Workspace:
    """Written tables that cut lineage: a lost executor rereads them instead of recomputing."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def write(self, frame: DataFrame, name: str) -> DataFrame:
        frame.write.option("compression", "zstd").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(frame.schema).parquet(f"{self.root}/{name}")

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def put(self, name: str, data: bytes) -> str:
        """Store one file of bounded size; returns its path."""
        target = f"{self.root}/{name}"
        path = self.spark._jvm.org.apache.hadoop.fs.Path(target)
        out = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(path, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        return target


def publish(space: Workspace, arrays: dict[str, np.ndarray]) -> str:
    """Store arrays of bounded size in the shared folder and have executors fetch them as files; returns their common name."""
    name = f"map-{uuid.uuid4().hex}"
    for part, values in arrays.items():
        space.spark.sparkContext.addFile(space.put(f"{name}.{part}", values.tobytes()))
    return name


def mapped(name: str, part: str, kind: type) -> np.ndarray:
    """A published array, memory-mapped by this worker from its executor's copy."""
    raw = np.memmap(SparkFiles.get(f"{name}.{part}"), dtype=np.uint8, mode="r") if name else np.zeros(0, dtype=np.uint8)
    return raw.view(kind)


def tasks(spark: SparkSession, per_core: int = 2) -> int:
    """How many tasks keep the cluster's cores busy."""
    return max(2, spark.sparkContext.defaultParallelism) * per_core


#: Rows that a step turns into Python objects at a time; Spark's batches hold thousands of whole texts.
SLICE = 256

#: Spark's names of the Arrow types that operators add.
DDL = {"int64": "long", "int32": "int", "double": "double", "string": "string", "binary": "binary", "bool": "boolean"}


def ddl(kind: pa.DataType) -> str:
    if pa.types.is_list(kind):
        return f"array<{ddl(kind.value_type)}>"
    if pa.types.is_struct(kind):
        return "struct<" + ", ".join(f"{f.name}: {ddl(f.type)}" for f in kind) + ">"
    return DDL[str(kind)]


def by_rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, SLICE) for at in range(0, batch.num_rows, SLICE))


def add_columns(
    frame: DataFrame, keep: list[str], new: dict[str, pa.DataType], make: Callable[[], Callable], cut: Callable = by_rows
) -> DataFrame:
    """``keep`` columns untouched, nulls included, and the ``new`` ones, batch by batch.

    ``make()`` is called once per task; what it returns is called with each slice that ``cut`` makes of
    an Arrow batch and gives the new columns in order, as lists or Arrow arrays.
    """
    columns = [f"`{c}` {frame.schema[c].dataType.simpleString()}" for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in (part for b in batches for part in cut(b)):
            made = [a if isinstance(a, (pa.Array, pa.ChunkedArray)) else pa.array(a, type=t) for a, t in zip(step(batch), new.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], names=[*keep, *new])

    return frame.mapInArrow(run, ", ".join([*columns, *(f"`{n}` {ddl(t)}" for n, t in new.items())]))
