"""Approximate nearest neighbours by NN-descent and greedy graph search.

A neighbour graph is started from random k-d leaves and improved by NN-descent: every round joins,
for each vector, its neighbours and some of those it is a neighbour of, compares them with each
other and keeps what improves their lists, until at most the share SETTLED of all edges is new. A query then walks the graph
greedily: the best unvisited vectors of its beam are joined to their neighbour lists, whose vectors
are compared with the query, until the beam stays. Both work on 8-bit copies of the vectors that
travel with the edges; the beam's final distances are computed on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count as count_from

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .embedding_dedup import cells, planes
from .shared import Workspace, add_columns, table, tasks

DEGREE, REVERSE, TREES, LEAF, SETTLED = 24, 14, 3, 256, 0.03
BEAM, WIDTH, SAMPLE = 480, 128, 20_000
EDGES = "v long, u long, d float"


def pack(vectors: np.ndarray) -> list[bytes]:
    """A scale and signed bytes for each row."""
    scale = np.maximum(np.abs(vectors).max(axis=1, keepdims=True), 1e-30).astype(np.float32)
    data = np.rint(vectors / scale * 127).astype(np.int8)
    return [s.tobytes() + d.tobytes() for s, d in zip(scale, data, strict=True)]


def unpack(codes: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(codes), dtype=np.uint8).reshape(len(codes), -1)
    scale = np.ascontiguousarray(raw[:, :4]).view(np.float32)
    return raw[:, 4:].view(np.int8).astype(np.float32) * (scale / 127)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T), 0)


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``key``."""
    left: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(keys, keys[-1]))
        if last:
            yield pa.Table.from_batches([*left, batch.slice(0, last)])
            left = []
        elif left and left[-1].column(key)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(left)
            left = []
        left.append(batch.slice(last))
    if left:
        yield pa.Table.from_batches(left)


def cuts_of(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(keys, prepend=keys[0] - 1, append=keys[-1] + 1))


def _edges(v: list, u: list, d: list) -> pa.RecordBatch:
    v, u, d = (np.concatenate(x) if x else np.zeros(0) for x in (v, u, d))
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(u, pa.int64()), pa.array(d, pa.float32())], names=["v", "u", "d"])


def _leaf(rows: pa.Table, degree: int) -> pa.Table:
    """Each vector's nearest in one leaf."""
    node, x = rows.column("node").to_numpy(), unpack(rows.column("code").to_pylist())
    k = min(degree, len(node) - 1)
    if k < 1:
        return pa.Table.from_batches([_edges([], [], [])])
    far = squared(x, x)
    np.fill_diagonal(far, np.inf)
    near = np.argpartition(far, k - 1, axis=1)[:, :k]
    return pa.Table.from_batches([_edges([np.repeat(node, k)], [node[near].ravel()], [np.take_along_axis(far, near, 1).ravel()])])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare the members of each neighbourhood, new ones with all, and give the edges that improve a list."""
    for rows in groups(batches, "v"):
        v, u = rows.column("v").to_numpy(), rows.column("u").to_numpy()
        fresh, worst, x = rows.column("fresh").to_numpy(), rows.column("worst").to_numpy(), unpack(rows.column("code").to_pylist())
        starts, ends, out = cuts_of(v), None, ([], [], [])
        for lo, hi in zip(starts, starts[1:]):
            new = fresh[lo:hi]
            if hi - lo < 2 or not new.any():
                continue
            own, far = u[lo:hi], squared(x[lo:hi], x[lo:hi])
            i, j = np.nonzero((new[:, None] | new) & (far < worst[lo:hi, None]) & (own[:, None] != own))
            for part, values in zip(out, (own[i], own[j], far[i, j]), strict=True):
                part.append(values)
        yield _edges(*out)


def _best(edges: DataFrame, parts: int, degree: int) -> DataFrame:
    """The nearest ``degree`` of each v, known edges counting as not fresh."""
    one = edges.repartition(parts, "v").groupBy("v", "u").agg(F.min("d").alias("d"), F.min("fresh").alias("fresh"))
    rank = F.row_number().over(Window.partitionBy("v").orderBy("d", "u"))
    return one.withColumn("k", rank).where(F.col("k") <= degree).drop("k")


def build_graph(nodes: DataFrame, space: Workspace, parts: int, degree: int = DEGREE) -> DataFrame:
    """(v, u, d, fresh): the neighbour graph of ``nodes`` (node long, code binary, spots array of leaves)."""
    spark = nodes.sparkSession
    spots = nodes.select("node", "code", F.posexplode("spots").alias("tree", "leaf"))
    sizes = space.write(spots.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / (2 * LEAF)).cast("int").alias("parts")), "leaves")
    spots = spots.join(sizes, ["tree", "leaf"]).withColumn("part", F.pmod(F.xxhash64("node", "tree"), F.col("parts")))
    key = ["tree", "leaf", "part"]
    first = spots.repartition(parts, *key).groupBy(key).applyInArrow(lambda t: _leaf(t.select(["node", "code"]), degree), EDGES)
    graph = space.write(_best(first.withColumn("fresh", F.lit(True)), parts, degree), "graph0")
    slim = nodes.select("node", "code")
    by_hash = Window.partitionBy("v").orderBy(F.desc("fresh"), F.xxhash64("v", "u"))
    for k in count_from(1):  # every round that goes on brings some list nearer, so this ends
        back = graph.select(F.col("u").alias("v"), F.col("v").alias("u"), "fresh").withColumn("k", F.row_number().over(by_hash))
        members = graph.select("v", "u", "fresh").union(back.where(F.col("k") <= REVERSE).drop("k"))
        worst = graph.groupBy(F.col("v").alias("w")).agg(F.when(F.count("*") >= degree, F.max("d")).otherwise(F.lit(float("inf"))).cast("float").alias("worst"))
        known = slim.join(worst, slim["node"] == worst["w"], "left").select("node", "code", F.coalesce("worst", F.lit(float("inf")).cast("float")).alias("worst"))
        met = members.join(known, members["u"] == known["node"]).select("v", "u", "fresh", "code", "worst")
        found = met.repartition(parts, "v").sortWithinPartitions("v").mapInArrow(_meet, EDGES)
        edges = graph.withColumn("fresh", F.lit(False)).unionByName(found.withColumn("fresh", F.lit(True)))
        graph = space.write(_best(edges, parts, degree), f"graph{k}")
        space.drop(f"graph{k - 1}")
        counts = graph.agg(F.count("*").alias("n"), F.count_if("fresh").alias("new")).first()
        if counts["new"] <= SETTLED * counts["n"]:
            break
    return graph


def _reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distances from each query to the neighbours of one beam vector, where below the beam's worst."""
    for batch in batches:
        out: tuple[list, list, list] = ([], [], [])
        q, bound, mine = batch.column("q").to_numpy(), batch.column("bound").to_numpy(), batch.column("mine").to_pylist()
        for k, (us, codes) in enumerate(zip(batch.column("us"), batch.column("codes"), strict=True)):
            us = us.values.to_numpy()
            far = squared(unpack([mine[k]]), unpack(codes.as_py()))[0]
            keep = far < bound[k]
            for part, values in zip(out, (np.full(keep.sum(), q[k]), us[keep], far[keep]), strict=True):
                part.append(values)
        yield _edges(*out)


def walk(graph: DataFrame, nodes: DataFrame, queries: DataFrame, space: Workspace, parts: int) -> DataFrame:
    """(q, node): for each query (q, node, code: a node to start from and the query's code) its beam at the end."""
    by_hash = Window.partitionBy("v").orderBy(F.xxhash64("v", "u"))
    back = graph.select(F.col("u").alias("v"), F.col("v").alias("u")).withColumn("k", F.row_number().over(by_hash)).where(F.col("k") <= DEGREE).drop("k")
    both = graph.select("v", "u").union(back).distinct().join(nodes.select(F.col("node").alias("u"), "code"), "u")
    lists = both.groupBy("v").agg(F.collect_list(F.struct("u", "code")).alias("l")).select("v", F.col("l.u").alias("us"), F.col("l.code").alias("codes"))
    lists = space.write(lists, "lists").repartition(parts, "v").persist()
    mine = queries.select(F.col("q").alias("qq"), F.col("code").alias("mine"))
    beam = space.write(queries.select("q", "node", F.lit(0.0).cast("float").alias("d"), F.lit(False).alias("done"), F.lit(True).alias("turn")), "beam0")
    order = Window.partitionBy("q")
    for hop in count_from(1):  # a vector that was visited isn't again, so this ends
        full = F.when(F.count("*") >= BEAM, F.max("d")).otherwise(F.lit(float("inf"))).cast("float")
        front = beam.where("turn").select("q", F.col("node").alias("v")).join(beam.groupBy(F.col("q").alias("qb")).agg(full.alias("bound")), F.col("q") == F.col("qb"))
        front = front.join(mine, F.col("q") == F.col("qq")).select("q", "v", "bound", "mine")
        seen = front.join(lists, "v").select("q", "bound", "mine", "us", "codes").mapInArrow(_reach, "v long, u long, d float")
        ahead = seen.select(F.col("v").alias("q"), F.col("u").alias("node"), "d", F.lit(False).alias("done"))
        merged = beam.select("q", "node", "d", (F.col("done") | F.col("turn")).alias("done")).union(ahead).repartition(parts, "q")
        merged = merged.groupBy("q", "node").agg(F.min("d").alias("d"), F.max("done").alias("done"))
        kept = merged.withColumn("k", F.row_number().over(order.orderBy("d", "node"))).where(F.col("k") <= BEAM)
        turn = ~F.col("done") & (F.sum((~F.col("done")).cast("int")).over(order.orderBy("d", "node").rowsBetween(Window.unboundedPreceding, 0)) <= WIDTH)
        beam = space.write(kept.withColumn("turn", turn).drop("k"), f"beam{hop}")
        space.drop(f"beam{hop - 1}")
        if beam.where("turn").isEmpty():
            break
    lists.unpersist()
    return beam.select("q", "node")


def nearest(frame: DataFrame, is_query, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's ``k`` nearest other rows by Euclidean distance.

    ``is_query`` is a condition on vec_id. Rows whose vector is null, empty, zero or holds a null or
    non-finite component take no part, nor do rows without a vec_id; of rows that share one, the
    smallest vector counts. Equal vectors are one vertex of the graph that carries its k + 1 smallest
    ids, more cannot be among the k nearest. Vectors of another length than the query's are not compared.
    With k candidates or fewer all are returned; ties go to the smaller vec_id.
    """
    spark, space = frame.sparkSession, Workspace(frame.sparkSession, "neighbours")
    rows = frame.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & sound).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    rows = space.write(rows, "rows")
    same = Window.partitionBy("embedding").orderBy("vec_id")
    few = rows.withColumn("k", F.row_number().over(same)).where(F.col("k") <= k + 1)
    classes = space.write(few.groupBy("embedding").agg(F.min("vec_id").alias("node"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "classes")
    found = None
    for dims in [r[0] for r in classes.select(F.size("embedding")).distinct().collect()]:
        own = Workspace(spark, f"neighbours-{dims}")
        part = _search(classes.where(F.size("embedding") == dims), rows.where(is_query & (F.size("embedding") == dims)), dims, own, k)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _search(classes: DataFrame, queries: DataFrame, dims: int, space: Workspace, k: int) -> DataFrame:
    spark = classes.sparkSession
    count = classes.count()
    parts = max(tasks(spark), count // 20_000)
    sample = classes.orderBy(F.xxhash64("node")).limit(SAMPLE).select("embedding").collect()
    points = np.array([r[0] for r in sample], dtype=np.float64)
    depth = min(max(0, int(np.ceil(np.log2(count / LEAF)))), int(np.log2(max(1, len(points) / 8))))
    turns = [np.linalg.qr(np.random.default_rng(t).standard_normal((dims, dims)))[0] for t in range(TREES)]
    trees = [planes((points @ r).astype(np.float32), depth) for r in turns]

    def place(batch: pa.RecordBatch) -> list[list]:
        x = np.array(batch.column("embedding").to_pylist(), dtype=np.float64)
        leaves = [cells((x @ r).astype(np.float32), t, depth, -1.0)[1] if depth else np.zeros(len(x), dtype=np.int64) for r, t in zip(turns, trees, strict=True)]
        return [pack(x.astype(np.float32)), np.stack(leaves, axis=1).tolist()]

    new = {"code": pa.binary(), "spots": pa.list_(pa.int32())}
    nodes = space.write(add_columns(classes.repartition(tasks(spark), "node").select("node", "embedding"), ["node"], new, lambda: place), "nodes")
    graph = build_graph(nodes, space, parts)
    at = queries.join(classes.select("node", "embedding"), "embedding").select(F.col("vec_id").alias("q"), "node", F.col("embedding").alias("x"))
    at = space.write(at, "queries")
    beam = walk(graph, nodes, at.select("q", "node").join(nodes.select("node", "code"), "node"), space, parts)
    exact = beam.join(at.select("q", "x"), "q").join(classes, "node")
    gap = F.aggregate(F.zip_with("x", "embedding", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, g: s + g)
    listed = exact.select("q", F.sqrt(gap).alias("score"), F.explode("ids").alias("vec_id")).where("vec_id <> q")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))
    best = listed.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select(F.col("q").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
