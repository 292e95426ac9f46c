"""Exports of tables as partitioned Parquet under a manifest that is written last."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

MANIFEST = "manifest.json"


def _checks(columns: list[str]) -> list[Column]:
    """Count and order-free checksum of rows; equal rows count as often as they occur."""
    return [F.count("*").alias("n_rows"), F.coalesce(F.sum(F.xxhash64(*sorted(columns)).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("checksum")]


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def write_export(tables: dict[str, tuple[DataFrame, list[str]]], path: str) -> dict:
    """Write each table, partitioned by its columns, into a new folder under ``path`` and then the manifest that names it.

    Counts and checksums are observed in the pass that writes. The manifest is put under another name and
    renamed, so a reader sees the export before or the whole new one; if a write fails, the manifest is
    left as it was.
    """
    version = f"data-{uuid.uuid4().hex}"
    entries = {}
    for name, (frame, parts) in tables.items():
        seen = Observation()
        spark = frame.sparkSession
        writer = frame.observe(seen, *_checks(frame.columns)).write
        (writer.partitionBy(*parts) if parts else writer).parquet(f"{path}/{version}/{name}")
        entries[name] = {"folder": f"{version}/{name}", "schema": frame.schema.json(), "partitions": parts, **seen.get}
    manifest = {"version": version, "tables": entries}
    files, staged = _files(spark, f"{path}/.{version}.json")
    out = files.create(staged, True)
    out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    out.close()
    _, final = _files(spark, f"{path}/{MANIFEST}")
    files.delete(final, False)
    if not files.rename(staged, final):
        raise OSError(f"the manifest of {path} could not be put in place")
    return manifest


def manifest_of(spark: SparkSession, path: str) -> dict:
    files, final = _files(spark, f"{path}/{MANIFEST}")
    if not files.exists(final):
        raise FileNotFoundError(f"{path} has no manifest, so no complete export")
    return json.loads("".join(r[0] for r in spark.read.text(f"{path}/{MANIFEST}", wholetext=True).collect()))


def read_export(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the export that the manifest names."""
    from pyspark.sql.types import StructType

    entry = manifest_of(spark, path)["tables"][name]
    schema = StructType.fromJson(json.loads(entry["schema"]))
    return spark.read.schema(schema).parquet(f"{path}/{entry['folder']}").select(*(f"`{c}`" for c in schema.names))


def verify_export(spark: SparkSession, path: str) -> DataFrame:
    """(name, n_rows, checksum, verified): what the manifest says of each table, and whether the files agree."""
    out = None
    for name, entry in sorted(manifest_of(spark, path)["tables"].items()):
        frame = read_export(spark, path, name)
        said = [F.lit(entry["n_rows"]).alias("said_rows"), F.lit(entry["checksum"]).alias("said_sum")]
        row = frame.agg(*_checks(frame.columns)).select(F.lit(name).alias("name"), "n_rows", "checksum", *said)
        row = row.select("name", "n_rows", "checksum", ((F.col("n_rows") == F.col("said_rows")) & (F.col("checksum") == F.col("said_sum"))).alias("verified"))
        out = row if out is None else out.unionByName(row)
    return out
