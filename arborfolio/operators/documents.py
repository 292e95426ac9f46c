"""Nested JSON documents: saved trees as tables, and canonical text with its hash.

A document's canonical text depends on that document alone, so its partitions are read in one pass.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts that a task turns into Python objects at a time.
SLICE = 256

#: A saved tree: its nodes with constraints and views, and the benchmark's weights.
TREE = """root_id STRING, benchmark STRUCT<weights: MAP<STRING, DOUBLE>>, nodes ARRAY<STRUCT<id: STRING, name: STRING, instruments: ARRAY<STRING>, children: ARRAY<STRING>, proxy: STRING, goal: STRUCT<objective: STRING>,
  constraints: STRUCT<min_weights: MAP<STRING, DOUBLE>, max_weights: MAP<STRING, DOUBLE>, per_asset_cap: DOUBLE, vol_target: DOUBLE, volatility_reference: STRING, view_tau: DOUBLE, mean_estimator: STRING,
    views: ARRAY<STRUCT<instruments: MAP<STRING, DOUBLE>, expected_return: DOUBLE, confidence: DOUBLE, source: STRING>>>>>"""


def ticker(name):
    """ticker:NAME, trimmed and in capitals; empty names are null. Other kinds of ids stay as they are."""
    bare = F.trim(name)
    return F.when(bare == "", None).when(F.lower(bare).startswith("cash:"), bare).otherwise(F.concat(F.lit("ticker:"), F.upper(F.trim(F.regexp_replace(bare, "^(?i)ticker:", "")))))


def tree_tables(documents: DataFrame) -> dict[str, DataFrame]:
    """Tables of the saved trees (tree_id, body): nodes, edges, instruments, bounds, views, benchmark and broken.

    Defaults: a node's name is its id, its objective min_risk, bounds 0 and 1 under the cap, tau 0.05, the mean's
    estimator auto; a volatility reference is manual if a target is stated, else none; a view's source is
    manual. Broken are the trees whose text is no such document.
    """
    parsed = documents.select("tree_id", F.from_json("body", TREE).alias("t"))
    whole = parsed.where("t.nodes IS NOT NULL AND t.root_id IS NOT NULL")
    rows = whole.select("tree_id", F.col("t.root_id").alias("root_id"), F.explode("t.nodes").alias("n")).withColumn("c", F.col("n.constraints"))
    default = lambda c, v: F.coalesce(F.col(c), F.lit(v))
    nodes = rows.select(
        "tree_id", F.col("n.id").alias("node_id"), F.coalesce("n.name", "n.id").alias("name"), ticker(F.col("n.proxy")).alias("proxy"), default("n.goal.objective", "min_risk").alias("objective"), (F.col("n.id") == F.col("root_id")).alias("is_root"),
        F.coalesce("c.volatility_reference", F.when(F.col("c.vol_target").isNotNull(), "manual").otherwise("none")).alias("volatility_reference"), F.col("c.vol_target").alias("vol_target"), default("c.view_tau", 0.05).alias("view_tau"), default("c.mean_estimator", "auto").alias("mean_estimator"),
    )
    instruments = rows.select("tree_id", F.col("n.id").alias("node_id"), "c", F.explode("n.instruments").alias("raw")).withColumn("instrument", ticker(F.col("raw")))
    of = lambda m: F.transform_keys(F.coalesce(F.col(m), F.create_map().cast("map<string,double>")), lambda k, v: ticker(k))
    cap = F.least(F.coalesce("c.per_asset_cap", F.lit(1.0)), F.lit(1.0))
    bounds = instruments.select("tree_id", "node_id", "instrument", F.coalesce(F.try_element_at(of("c.min_weights"), "instrument"), F.lit(0.0)).alias("lo"), F.least(F.coalesce(F.try_element_at(of("c.max_weights"), "instrument"), F.lit(1.0)), cap).alias("hi"))
    views = rows.select("tree_id", F.col("n.id").alias("node_id"), F.posexplode("c.views").alias("view_id", "v"))
    views = views.select("tree_id", "node_id", "view_id", F.explode("v.instruments").alias("raw", "coef"), F.col("v.expected_return").alias("expected_return"), F.col("v.confidence").alias("confidence"), default("v.source", "manual").alias("source"))
    return {
        "nodes": nodes,
        "edges": rows.select("tree_id", F.col("n.id").alias("parent_id"), F.explode("n.children").alias("child_id")),
        "instruments": instruments.select("tree_id", "node_id", "instrument"),
        "bounds": bounds,
        "views": views.select("tree_id", "node_id", "view_id", ticker(F.col("raw")).alias("instrument"), "coef", "expected_return", "confidence", "source"),
        "benchmark": whole.select("tree_id", F.explode("t.benchmark.weights").alias("raw", "weight")).select("tree_id", ticker(F.col("raw")).alias("instrument"), "weight"),
        "broken": parsed.where("t.nodes IS NULL OR t.root_id IS NULL").select("tree_id"),
    }


class _NotFinite(Exception):
    """A JSON text holds a number that no double does."""


def canonical_text(body: str) -> str:
    """The canonical text of a JSON text; ValueError if it is malformed or repeats a key, _NotFinite, RecursionError if it nests too deeply."""
    beyond = False

    def number(kind: type):
        def read(digits: str):
            nonlocal beyond
            value = float(digits) if kind is float or len(digits) > 308 else None
            if value is not None and math.isinf(value):
                beyond = True
                return 0
            return value if kind is float else int(digits)

        return read

    def object_of(pairs: list[tuple]) -> dict:
        found = dict(pairs)
        if len(found) < len(pairs):
            raise ValueError("a key is repeated")
        return found

    def refuse(name: str):
        raise ValueError(f"{name} is no JSON")

    value = json.loads(body, parse_float=number(float), parse_int=number(int), parse_constant=refuse, object_pairs_hook=object_of)
    if beyond:
        raise _NotFinite
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode("utf-8", "replace").decode()


def _told(body: str | None) -> tuple[str | None, str | None]:
    try:
        return (None, "malformed") if body is None else (canonical_text(body), None)
    except _NotFinite:
        return None, "not finite"
    except RecursionError:
        return None, "too deep"
    except ValueError:
        return None, "malformed"


def canonical_documents(documents: DataFrame) -> DataFrame:
    """(id, canonical, hash, problem) for JSON texts (id, body).

    Keys come in order of their code points, without spaces, text outside ASCII as it is; whole numbers
    keep their digits, others are the shortest text of their double, and stay fractions (1.0). A text that
    is null, malformed (NaN among it) or repeats a key of an object is ``malformed``, one with a number that no double holds
    ``not finite``, one whose nesting exceeds what Python's reader takes (thousands of levels) ``too deep``; these have no
    canonical text. A text stands alone, so this is one pass without a shuffle, with repeated ids each told.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            told = [_told(t) for t in batch.column("body").to_pylist()]
            made = [pa.array(c, pa.string()) for c in (zip(*told, strict=True))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *made], names=["id", "canonical", "problem"])

    kind = documents.schema["id"].dataType.simpleString()
    told = documents.select("id", "body").mapInArrow(run, f"id {kind}, canonical string, problem string")
    return told.select("id", "canonical", F.concat(F.lit("sha256:"), F.sha2("canonical", 256)).alias("hash"), "problem")
