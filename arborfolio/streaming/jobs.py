"""Streaming forms of event-time jobs, each run to the end of what has arrived.

Results leave a stream by ``foreachBatch`` as Parquet in the shared folder, one folder a batch that a
repeated batch overwrites; the last batch's row of a key is its current value.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from arborfolio.sources.written import shared_dir


def arriving(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet file, or the files of the folder, at ``path``."""
    as_glob = f"{path[:-1]}[{path[-1]}]"  # a plain path would have to be a folder
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(as_glob)


def run_to_end(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over everything there is; all rows it gave, with their batch."""
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(f"{','.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema.fields)}, batch int").parquet(f"{root}/out")


def current(rows: DataFrame, key: list[str]) -> DataFrame:
    """The last batch's row of each key."""
    last = Window.partitionBy(key).orderBy(F.desc("batch"))
    return rows.withColumn("k", F.row_number().over(last)).where("k = 1").drop("k", "batch")


def period_returns(feed: DataFrame, late: str = "1 day") -> DataFrame:
    """(week_end, instrument, ret) from a feed (ts, instrument, ret): weeks from Saturday to Friday, compounded.

    Rows later than the watermark are dropped.
    """
    week = F.window("ts", "7 days", startTime="2 days")
    stream = feed.withWatermark("ts", late).groupBy(week, "instrument").agg((F.product(1 + F.col("ret")) - 1).alias("ret"))
    flat = stream.select(F.date_sub(F.to_date("window.end"), 1).alias("week_end"), "instrument", "ret")
    return current(run_to_end(flat, "update"), ["week_end", "instrument"])


def transitions(feed: DataFrame) -> DataFrame:
    """(key, ts, before, state) of a feed (key, ts, seq, state) where a key's state changes; its first state counts, as does one after a missing state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(batches, ignore_index=True).sort_values(["ts", "seq"])  # a key's rows may come in several batches, each numbered from 0
        now = rows["state"].to_numpy(dtype=object)
        before = np.append(np.array([state.get[0] if state.exists else None], dtype=object), now[:-1])
        changed = pd.isna(before) | (~pd.isna(now) & (now != before))
        state.update((now[-1],))
        if changed.any():
            yield pd.DataFrame({"key": key[0], "ts": rows["ts"].to_numpy()[changed], "before": before[changed], "state": now[changed]})

    out = feed.groupBy("key").applyInPandasWithState(step, "key long, ts timestamp, before string, state string", "state string", "update", GroupStateTimeout.NoTimeout)
    return run_to_end(out, "update").drop("batch")


def last_heartbeats(feed: DataFrame) -> DataFrame:
    """(job, heartbeat): the latest heartbeat of each job of a feed (job, ts)."""
    return current(run_to_end(feed.groupBy("job").agg(F.max("ts").alias("heartbeat")), "update"), ["job"])


def stale(heartbeats: DataFrame, running: DataFrame, timeout: str) -> DataFrame:
    """Running jobs whose last heartbeat is older than ``timeout`` before the newest one."""
    newest = heartbeats.agg(F.max("heartbeat").alias("newest"))
    known = heartbeats.join(running, "job", "left_semi").crossJoin(F.broadcast(newest))
    return known.where(F.expr(f"heartbeat < newest - INTERVAL {timeout}")).select("job", "heartbeat")
