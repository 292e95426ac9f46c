"""Allocation trees: walks, passes of allocation, composed weights, node series and exposures.

Trees are edges (parent_id, child_id) of any depth. Walks loop over levels, one join a level and
never over nodes; each level is written, and the loop ends with the first empty one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborfolio.operators import allocation as al
from arborfolio.sources.written import grow, shared_dir

DROPPED = 1e-12


def walk(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node_id, depth, path, root_id) for every node below the roots (column node_id); paths join ids with /.

    An edge back to a node of its own path, a cycle, is not followed.
    """
    text = lambda c: F.col(c).cast("string")
    first = roots.select("node_id", F.lit(0).alias("depth"), text("node_id").alias("path"), F.col("node_id").alias("root_id"), F.array("node_id").alias("met"))

    def step(level: DataFrame) -> DataFrame:
        below = level.join(edges, level["node_id"] == edges["parent_id"]).where(~F.array_contains("met", F.col("child_id")))
        return below.select(
            F.col("child_id").alias("node_id"), (F.col("depth") + 1).alias("depth"), F.concat_ws("/", "path", text("child_id")).alias("path"), "root_id",
            F.array_append("met", F.col("child_id")).alias("met"),
        )

    return grow(first, step).drop("met")


def subtree_terminals(edges: DataFrame, node_instruments: DataFrame) -> DataFrame:
    """(node_id, instrument) for the instruments of a node and of all below it."""
    everyone = edges.select(F.col("parent_id").alias("node_id")).union(edges.select("child_id")).distinct()
    below = walk(edges, everyone).select(F.col("root_id").alias("top"), "node_id")
    return below.join(node_instruments, "node_id").select(F.col("top").alias("node_id"), "instrument").distinct()


def compose(root: DataFrame, child_weights: DataFrame, own_weights: DataFrame) -> DataFrame:
    """(key.., instrument, weight): products of weights along the paths from the root, summed.

    ``root`` (key.., node_id), ``child_weights`` (key.., parent_id, child_id, weight) and ``own_weights``
    (key.., node_id, instrument, weight) share those key columns that they have. Weights within 1e-12 of
    zero go.
    """
    key = [c for c in root.columns if c != "node_id"]
    reach = node_weights(root, child_weights)
    held = reach.withColumnRenamed("weight", "global").join(own_weights, [*(c for c in key if c in own_weights.columns), "node_id"])
    total = held.groupBy(*key, "instrument").agg(F.sum(F.col("global") * F.col("weight")).alias("weight"))
    return total.where(F.abs("weight") > DROPPED)


def node_weights(root: DataFrame, child_weights: DataFrame) -> DataFrame:
    """(key.., node_id, weight): each node's share of the whole, one row a path. A cycle is not followed."""
    key = [c for c in root.columns if c != "node_id"]
    on = [c for c in key if c in child_weights.columns]

    def step(level: DataFrame) -> DataFrame:
        up = level.withColumnsRenamed({"node_id": "parent_id", "weight": "above"})
        below = up.join(child_weights, [*on, "parent_id"]).where(~F.array_contains("met", F.col("child_id")))
        met = F.array_append("met", F.col("child_id")).alias("met")
        return below.select(*key, F.col("child_id").alias("node_id"), (F.col("above") * F.col("weight")).alias("weight"), met)

    return grow(root.select(*key, "node_id", F.lit(1.0).alias("weight"), F.array("node_id").alias("met")), step).drop("met")


#: Weights (fold_id, node_id, instrument, weight) from series (fold_id, node_id, instrument, date, ret) and bounds ([fold_id,] node_id, instrument, lo, hi).
Allocator = Callable[[DataFrame, DataFrame], DataFrame]


def by_mean_return(series: DataFrame, bounds: DataFrame) -> DataFrame:
    """The highest mean return within the bounds, for every fold and node at once."""
    means = series.groupBy("fold_id", "node_id", "instrument").agg(F.avg("ret").alias("mu"))
    rows = means.join(bounds, [c for c in bounds.columns if c in ("fold_id", "node_id", "instrument")])
    return al.max_return(rows.drop("lo", "hi"), rows.drop("mu"), ["fold_id", "node_id"])


def _node_key(slots: DataFrame) -> list[str]:
    """What tells nodes apart: their id, and the fold where every fold has a tree of its own."""
    return [c for c in ("fold_id", "node_id") if c in slots.columns]


def forward_pass(slots: DataFrame, returns: DataFrame, allocate: Allocator = by_mean_return) -> DataFrame:
    """(fold_id, node_id, instrument, child_id, weight): every node allocated on the raw series of its instruments and of its children's proxies.

    ``slots`` ([fold_id,] node_id, instrument, child_id, lo, hi): what a node may hold; child_id is null for an
    instrument, and the instrument of a child is its proxy. With a fold_id every fold has its own tree.
    ``returns`` (fold_id, instrument, date, ret). Nodes don't depend on each other, so one job takes them all.
    """
    node = _node_key(slots)
    series = slots.select(*node, "instrument").join(returns, [*node[:-1], "instrument"])
    found = allocate(series.select("fold_id", "node_id", "instrument", "date", "ret"), slots.select(*node, "instrument", "lo", "hi"))
    return found.join(slots.select(*node, "instrument", "child_id"), [*node, "instrument"]).select("fold_id", "node_id", "instrument", "child_id", "weight")


def backward_pass(slots: DataFrame, depths: DataFrame, returns: DataFrame, allocate: Allocator = by_mean_return, forward: DataFrame | None = None) -> DataFrame:
    """(fold_id, node_id, instrument, child_id, weight): nodes allocated from the deepest level up, each on its children's own series.

    A child stands in its parent's slots by the return of what it holds itself, named proxy_SYNTH.
    Nodes without children take their weights of ``forward``; without it they are allocated here
    (the direct bottom-up pass). ``depths`` has (node_id, depth); a child's is greater than its parent's. Slots with a
    fold_id give every fold its own tree. The loop is over depths; each level's weights and series are written before the next.
    """
    spark, root, node = slots.sparkSession, f"{shared_dir(slots.sparkSession)}/backward-{uuid.uuid4().hex}", _node_key(slots)
    parents = slots.where("child_id IS NOT NULL").select(node).distinct()
    named = slots.withColumn("instrument", F.when(F.col("child_id").isNull(), F.col("instrument")).otherwise(F.concat("instrument", F.lit("_SYNTH"))))
    deepest, weights, series = depths.agg(F.max("depth")).first()[0], [], None
    for depth in range(-1 if deepest is None else deepest, -1, -1):
        here = named.join(depths.where(F.col("depth") == depth).select("node_id"), "node_id", "left_semi")
        raw = here.where("child_id IS NULL").select(*node, "instrument").join(returns, [*node[:-1], "instrument"])
        rows = raw.select("fold_id", "node_id", "instrument", "date", "ret")
        if series is not None:
            below = series.select("fold_id", F.col("node_id").alias("child_id"), "date", "ret")
            rows = rows.unionByName(here.join(below, [*node[:-1], "child_id"]).select("fold_id", "node_id", "instrument", "date", "ret"))
        solve, kept = here, None
        if forward is not None:
            solve = here.join(parents, node, "left_semi")
            leaves = here.join(parents, node, "left_anti").select(node).distinct()
            kept = forward.join(leaves, node, "left_semi")
        found = allocate(rows.join(solve.select(node).distinct(), node, "left_semi"), solve.select(*node, "instrument", "lo", "hi"))
        level = found.join(here.select(*node, "instrument", "child_id"), [*node, "instrument"]).select("fold_id", "node_id", "instrument", "child_id", "weight")
        level = level if kept is None else level.unionByName(kept.select(level.columns))
        level.write.parquet(f"{root}/weights{depth}")
        level = spark.read.schema(level.schema).parquet(f"{root}/weights{depth}")
        weights.append(f"{root}/weights{depth}")
        own = node_series(level.select("fold_id", "node_id", "instrument", "weight"), rows.select("fold_id", "node_id", "instrument", "date", "ret"), ["fold_id", "node_id"])
        own.write.parquet(f"{root}/series{depth}")
        own = spark.read.schema(own.schema).parquet(f"{root}/series{depth}")
        series = own if series is None else series.unionByName(own)
    if not weights:
        raise ValueError("a tree without nodes has no allocation")
    return spark.read.schema(level.schema).parquet(*weights)


def terminal_weights(weights: DataFrame, tops: DataFrame) -> DataFrame:
    """(fold_id, top, instrument, weight): what each of the nodes ``tops`` (column node_id) holds in the end, by the weights of a pass."""
    start = weights.select("fold_id").distinct().crossJoin(F.broadcast(tops.select(F.col("node_id").alias("top"), "node_id").distinct()))
    inner = weights.where("child_id IS NOT NULL").select("fold_id", F.col("node_id").alias("parent_id"), "child_id", "weight")
    return compose(start, inner, weights.where("child_id IS NULL").select("fold_id", "node_id", "instrument", "weight"))


def node_series(weights: DataFrame, returns: DataFrame, key: list[str]) -> DataFrame:
    """(key.., node_id, date, ret): the return of each node's own portfolio."""
    return weights.join(returns, [c for c in returns.columns if c in (*key, "instrument")]).groupBy(*dict.fromkeys([*key, "node_id"]), "date").agg(F.sum(F.col("weight") * F.col("ret")).alias("ret"))


def node_candidates(node_instruments: DataFrame, edges: DataFrame, proxies: DataFrame, backward: bool) -> DataFrame:
    """(node_id, candidate, kind): a node's instruments, and its children by proxy or by synthetic series."""
    own = node_instruments.select("node_id", F.col("instrument").alias("candidate"), F.lit("instrument").alias("kind"))
    child = edges.join(proxies, edges["child_id"] == proxies["node_id"]).select(F.col("parent_id").alias("node_id"), "proxy")
    name = F.concat("proxy", F.lit("_SYNTH")) if backward else F.col("proxy")
    return own.unionByName(child.select("node_id", name.alias("candidate"), F.lit("synthetic" if backward else "proxy").alias("kind")))


def implemented_benchmark(benchmark: DataFrame, proxies: DataFrame, child_weights: DataFrame) -> DataFrame:
    """(instrument, weight): weight on a child's proxy replaced by that child's own instruments."""
    joined = benchmark.withColumnRenamed("instrument", "held").join(proxies.select("node_id", F.col("proxy").alias("held")), "held", "left")
    spread = joined.join(child_weights.select("node_id", "instrument", F.col("weight").alias("inner")), "node_id", "left")
    name, weight = F.coalesce("instrument", "held"), F.col("weight") * F.coalesce("inner", F.lit(1.0))
    return spread.groupBy(name.alias("instrument")).agg(F.sum(weight).alias("weight"))


def exposures(weights: DataFrame, key: list[str]) -> DataFrame:
    """Per key: risky, cash and net exposure."""
    cash = F.col("instrument").startswith("cash:")
    return weights.groupBy(key).agg(
        F.sum(F.when(~cash, F.col("weight")).otherwise(0.0)).alias("risky"), F.sum(F.when(cash, F.col("weight")).otherwise(0.0)).alias("cash"), F.sum("weight").alias("net")
    )


def inverse_variance_split(edges_of: DataFrame, variances: DataFrame, key: list[str]) -> DataFrame:
    """(key.., parent_id, child_id, weight): each parent's budget split by the inverse variance of its children.

    ``edges_of`` (parent_id, child_id), ``variances`` (key.., child_id, var); children without a variance get nothing.
    """
    joined = edges_of.join(variances.where("var > 0"), "child_id").withColumn("inverse", 1 / F.col("var"))
    total = joined.groupBy(*key, "parent_id").agg(F.sum("inverse").alias("total"))
    return joined.join(total, [*key, "parent_id"]).select(*key, "parent_id", "child_id", (F.col("inverse") / F.col("total")).alias("weight"))
