from datetime import datetime, timedelta

import pytest

from arborfolio.streaming import jobs


@pytest.fixture
def small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "3")
    yield
    spark.conf.set(name, before)


def test_transitions_of_keys_in_several_batches(spark, tmp_path, small_batches):
    at = lambda k: datetime(2024, 1, 1) + timedelta(hours=k)
    feeds = {1: "aabbbcca", 2: "ddddd", None: "ab"}
    rows = [(key, at(k), k, s) for key, states in feeds.items() for k, s in enumerate(states)]
    rows += [(3, at(0), 0, None), (3, at(1), 1, "a"), (3, at(2), 2, None), (3, at(3), 3, "a")]
    path = str(tmp_path / "feed.parquet")
    spark.createDataFrame(rows[::-1], "key long, ts timestamp, seq int, state string").coalesce(1).write.parquet(path)
    got = {(r.key, r.ts, r.before, r.state) for r in jobs.transitions(jobs.arriving(spark, path)).collect()}
    want = {(1, at(0), None, "a"), (1, at(2), "a", "b"), (1, at(5), "b", "c"), (1, at(7), "c", "a"), (2, at(0), None, "d"), (None, at(0), None, "a"), (None, at(1), "a", "b")}
    assert got == want | {(3, at(0), None, None), (3, at(1), None, "a"), (3, at(3), None, "a")}


def test_trees_of_a_small_file_are_spread_over_the_cores(spark):
    from arborfolio.plans import document_queries as dq

    assert dq.settings(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
