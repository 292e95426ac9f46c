"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors are rotated at random and split into blocks of few dimensions. Two vectors within the
squared distance that the cosine allows are, in at least one block, within that block's share of it.
So every block is range-joined on its own under its share, and the union of what the blocks find is
verified by the exact cosine of the original vectors in double precision.

The range join of a block deals vectors to the cells of a k-d partition (its planes are fitted on a
bounded sample; every vector is dealt): to the cell it lives in and to each lower-numbered cell that
its search ball touches. A pair is compared where the one lives and the other lives or visits, and
counts in its first block only, so links are counted without a list of pairs. A crowded cell is
dealt over tiles, each comparing two parts of it.

What is dealt is the rotated unit vector on a 16-bit grid, whose error has a bound. Distances on the
grid are sums of whole numbers, the same in every task. A pair whose grid distance is further from
the limit than the bound is decided there; the few pairs within it are joined to the original
vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import Workspace, add_columns, table, tasks

THRESHOLD, BLOCK_DIMS, SEED = 0.95, 8, 11
#: Vectors the k-d planes are fitted on, vectors a cell should hold, and parts of a crowded cell.
SAMPLE, CELL_ROWS, PART_ROWS = 20_000, 8192, 8192
SLACK, GRID = 1e-3, 32_767


def rotation(dims: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(SEED).standard_normal((dims, dims)))[0]


def block_cuts(dims: int, block_dims: int = BLOCK_DIMS) -> list[tuple[int, int]]:
    count = max(1, dims // block_dims)
    cuts = [dims * i // count for i in range(count + 1)]
    return list(zip(cuts, cuts[1:]))


def grid_error(dims: int) -> float:
    """How far a distance of two unit vectors may move by rounding both to the grid."""
    return 1.05 * np.sqrt(dims) / GRID + 1e-6


def limits(dims: int, threshold: float) -> np.ndarray:
    """Each block's share of the squared distance, by its dimensions, with room for the grid."""
    share = np.array([np.sqrt((2 - 2 * threshold) * (hi - lo) / dims) for lo, hi in block_cuts(dims)])
    return (share + grid_error(dims)) ** 2


def rotated(vectors: np.ndarray) -> np.ndarray:
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.rint(unit @ rotation(vectors.shape[1]) * GRID).astype(np.int16)


def planes(points: np.ndarray, depth: int) -> np.ndarray:
    """Thresholds of a complete k-d tree in heap order; level k cuts dimension k at the median."""
    found, groups = np.zeros(max(1, (1 << depth) - 1), dtype=np.float32), [points]
    for level in range(depth):
        axis, next_ = level % points.shape[1], []
        for i, g in enumerate(groups):
            cut = np.float32(np.median(g[:, axis])) if len(g) else np.float32(0)
            found[(1 << level) - 1 + i] = cut
            next_ += [g[g[:, axis] < cut], g[g[:, axis] >= cut]]
        groups = next_
    return found


def cells(points: np.ndarray, tree: np.ndarray, depth: int, radius2: float) -> tuple[np.ndarray, np.ndarray]:
    """(point, cell) for every cell that a point's ball touches; cells are leaves from 0."""
    who, node = np.arange(len(points)), np.zeros(len(points), dtype=np.int64)
    off = np.zeros(points.shape, dtype=np.float64)
    for level in range(depth):
        axis = level % points.shape[1]
        gap = points[who, axis].astype(np.float64) - tree[node]
        right = gap >= 0
        far_off = off.copy()
        far_off[:, axis] = gap * gap
        touch = far_off.sum(axis=1) <= radius2 * (1 + SLACK)
        node, far = 2 * node + 1 + right, 2 * node + 2 - right
        who, node, off = np.concatenate([who, who[touch]]), np.concatenate([node, far[touch]]), np.concatenate([off, far_off[touch]])
    return who, node - ((1 << depth) - 1)


def _place(model: dict, threshold: float):
    """For a batch of distinct vectors: bytes of the rotated ones on the grid, and cells."""

    def step(batch: pa.RecordBatch) -> list[list]:
        vectors = [np.array(v, dtype=np.float32) for v in batch.column("embedding").to_pylist()]
        turned, spots = [b""] * len(vectors), [[] for _ in vectors]
        for dims in {len(v) for v in vectors}:
            rows = [i for i, v in enumerate(vectors) if len(v) == dims]
            turn = rotated(np.array([vectors[i] for i in rows], dtype=np.float64))
            depth, trees = model.get(dims, (0, None))
            for b, ((lo, hi), limit) in enumerate(zip(block_cuts(dims), limits(dims, threshold), strict=True)):
                part = (turn[:, lo:hi] / GRID).astype(np.float32)
                who, cell = cells(part, trees[b] if depth else None, depth, limit)
                home = cell[: len(rows)]  # the near side of every plane comes first
                for w, c in zip(who.tolist(), cell.tolist(), strict=True):
                    if c <= home[w]:
                        spots[rows[w]].append({"block": b, "cell": c, "home": bool(c == home[w])})
            for k, i in enumerate(rows):
                turned[i] = turn[k].tobytes()
        return [turned, spots]

    return step


def tile_links(block: int, turn: np.ndarray, home: np.ndarray, own: np.ndarray, kind: str, threshold: float, step: int = 256, most: int = 1 << 22):
    """Pairs (i, j, sure) of one tile within reach that have ``block`` as their first block, in pieces.

    Tiles of kind 'h' compare residents with each other, those of kind 'v' residents with visitors.
    Vectors of at most ``most`` coordinates are compared at a time.
    """
    dims = turn.shape[1]
    cuts, limit = block_cuts(dims), limits(dims, threshold) * GRID**2
    lo, hi = cuts[block]
    grid, reach, error = turn.astype(np.float64), np.sqrt(2 - 2 * threshold), grid_error(dims)
    low, high = ((reach - error) * GRID) ** 2, ((reach + error) * GRID) ** 2
    if kind == "v":
        left, right = np.flatnonzero(home), np.flatnonzero(~home)
    elif own.min() != own.max():
        left, right = np.flatnonzero(own == own.min()), np.flatnonzero(own == own.max())
    else:
        left = right = np.arange(len(own))
    x, y = grid[left, lo:hi], grid[right, lo:hi]
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    for at in range(0, len(left), step):
        near = xx[at : at + step, None] + yy - 2 * (x[at : at + step] @ y.T) <= limit[block]
        if left is right:
            near &= np.arange(len(right)) > np.arange(at, min(at + step, len(left)))[:, None]
        i_all, j_all = np.nonzero(near)
        some = max(1, most // dims)
        for s in range(0, len(i_all), some):
            i, j = left[i_all[s : s + some] + at], right[j_all[s : s + some]]
            for b in range(block):
                gap = grid[i, cuts[b][0] : cuts[b][1]] - grid[j, cuts[b][0] : cuts[b][1]]
                later = (gap * gap).sum(axis=1) > limit[b]
                i, j = i[later], j[later]
            gap = grid[i] - grid[j]
            far = (gap * gap).sum(axis=1)
            yield i[far <= low], j[far <= low], True
            doubt = (far > low) & (far <= high)
            yield i[doubt], j[doubt], False


def _hook(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    while True:
        a, b = parent[i], parent[j]
        if (a == b).all():
            return
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent != (up := parent[parent])).any():
            parent[:] = up


FOUND = pa.schema([("kind", pa.string()), ("a", pa.int64()), ("a_code", pa.int64()), ("b", pa.int64()), ("b_code", pa.int64()), ("n", pa.int64())])


def _tile(rows: pa.Table, threshold: float) -> pa.Table:
    """Link counts, links that connect what is linked, and pairs in doubt of one tile."""
    dims, block, kind = (rows.column(c)[0].as_py() for c in ("dims", "block", "kind"))
    turn = np.frombuffer(b"".join(rows.column("turned").to_pylist()), dtype=np.int16).reshape(-1, dims)
    rep, code, weight, home, own = (rows.column(c).to_numpy() for c in ("rep", "code", "copies", "home", "own"))
    count, parent, doubt = np.zeros(len(rep), dtype=np.int64), np.arange(len(rep)), []
    for i, j, sure in tile_links(block, turn, home.astype(bool), own, kind, threshold):
        if sure:
            np.add.at(count, i, weight[j])
            np.add.at(count, j, weight[i])
            _hook(parent, i, j)
        elif len(i):
            doubt.append((i, j))
    some, moved = np.flatnonzero(count), np.flatnonzero(parent != np.arange(len(rep)))
    i, j = (np.concatenate(x) for x in zip(*doubt)) if doubt else (np.zeros(0, dtype=np.int64),) * 2
    none = [None]
    columns = [
        ["count"] * len(some) + ["link"] * len(moved) + ["doubt"] * len(i),
        np.concatenate([rep[some], rep[moved], rep[i]]),
        np.concatenate([code[some], code[moved], code[i]]),
        none * len(some) + rep[parent[moved]].tolist() + rep[j].tolist(),
        none * (len(some) + len(moved)) + code[j].tolist(),
        count[some].tolist() + none * (len(moved) + len(i)),
    ]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, FOUND, strict=True)], schema=FOUND)


def _decide(doubt: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(a, a_code, b, b_code, a_n, b_n): the pairs in doubt whose exact cosine reaches the threshold."""
    side = lambda s: classes.select(F.col("rep").alias(s), F.col("code").alias(f"{s}_code"), F.col("embedding").alias(f"{s}_x"), F.col("copies").alias(f"{s}_n"))
    both = doubt.join(side("a"), ["a", "a_code"]).join(side("b"), ["b", "b_code"])
    add = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda t, v: t + v)
    cosine = add("a_x", "b_x") / (F.sqrt(add("a_x", "a_x")) * F.sqrt(add("b_x", "b_x")))
    return both.where(cosine >= threshold).select("a", "a_code", "b", "b_code", "a_n", "b_n")


def link_near(frame: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row with columns vec_id and embedding.

    Rows whose vector is null, empty, zero or holds a null or non-finite component, and rows without
    a vec_id, link with nothing. Equal vectors form a class that is compared once; its members link
    with each other. Vectors of different length never link. Repeated rows stay repeated.
    """
    spark, space = frame.sparkSession, Workspace(frame.sparkSession, "embeddings")
    rows = frame.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("code", F.xxhash64("embedding"))
    classes = rows.where(F.col("vec_id").isNotNull() & sound).groupBy("code", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = space.write(classes, "classes")
    model = {}
    for dims, count in ((r["d"], r["count"]) for r in classes.groupBy(F.size("embedding").alias("d")).count().collect()):
        depth = max(0, int(np.ceil(np.log2(count / CELL_ROWS)))) if count > CELL_ROWS else 0
        if depth:
            sample = classes.where(F.size("embedding") == dims).orderBy(F.xxhash64("code", F.lit(SEED))).limit(SAMPLE).select("embedding").collect()
            turn = (rotated(np.array([r[0] for r in sample], dtype=np.float64)) / GRID).astype(np.float32)
            depth = min(depth, int(np.log2(max(1, len(sample) / 16))))
            model[dims] = depth, [planes(turn[:, lo:hi], depth) for lo, hi in block_cuts(dims)]
    spot = pa.list_(pa.struct([("block", pa.int32()), ("cell", pa.int32()), ("home", pa.bool_())]))
    spread = classes.repartition(tasks(spark), "code")
    new = {"turned": pa.binary(), "spots": spot}
    placed = space.write(
        add_columns(spread.withColumn("dims", F.size("embedding")), ["rep", "code", "copies", "dims"], new, lambda: _place(model, threshold)), "placed"
    )
    key = ["dims", "block", "cell"]
    split = lambda c: F.ceil(F.count_if(c) / PART_ROWS).cast("int")
    sizes = placed.select("dims", F.inline("spots")).groupBy(key).agg(split(F.col("home")).alias("homes"), split(~F.col("home")).alias("guests"))
    sizes = space.write(sizes, "sizes")
    tiles = sizes.agg(F.sum(F.col("homes") * (F.col("homes") + 1) / 2 + F.col("homes") * F.col("guests"))).first()[0] or 1
    dealt = placed.select("rep", "code", "copies", "dims", "turned", F.inline("spots")).join(sizes, key)
    own = F.pmod(F.xxhash64("code", "rep"), F.when(F.col("home"), F.col("homes")).otherwise(F.col("guests"))).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("tile", F.explode(F.expr("""
        CASE WHEN home AND guests > 0 THEN concat(
            transform(sequence(0, homes - 1), k -> struct('h' AS kind, least(own, k) AS low, greatest(own, k) AS high)),
            transform(sequence(0, guests - 1), k -> struct('v' AS kind, own AS low, k AS high)))
        WHEN home THEN transform(sequence(0, homes - 1), k -> struct('h' AS kind, least(own, k) AS low, greatest(own, k) AS high))
        ELSE transform(filter(sequence(0, homes), k -> k < homes), k -> struct('v' AS kind, k AS low, own AS high)) END""")))
    dealt = dealt.select("rep", "code", "copies", "turned", "home", "own", *key, "tile.*")
    whole = [*key, "kind", "low", "high"]
    dealt = dealt.repartition(int(min(20_000, max(4 * tasks(spark), tiles))), *whole)
    schema = "kind string, a long, a_code long, b long, b_code long, n long"
    found = space.write(dealt.groupBy(whole).applyInArrow(lambda t: _tile(t, threshold), schema), "found")
    exact = space.write(_decide(found.where("kind = 'doubt'").select("a", "a_code", "b", "b_code"), classes, threshold), "exact")
    groups = components(found.where("kind = 'link'").select("a", "b").unionByName(exact.select("a", "b")))
    counts = found.where("kind = 'count'").select("a", "a_code", "n")
    counts = counts.union(exact.select("a", "a_code", "b_n")).union(exact.select("b", "b_code", "a_n"))
    counts = counts.groupBy(F.col("a").alias("rep"), F.col("a_code").alias("code")).agg(F.sum("n").alias("n"))
    known = classes.join(counts, ["rep", "code"], "left").join(groups, F.col("rep") == F.col("node"), "left")
    known = known.select("code", "embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("component"))
    joined = rows.join(known, ["code", "embedding"], "left")
    own = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    n_links = F.when(F.col("vec_id").isNotNull(), F.coalesce("n", F.lit(0))).otherwise(0).cast("long")
    return joined.select("vec_id", n_links.alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_near(table(spark, sf_dir, "embeddings"))


OP3_SQL = f"""
WITH RECURSIVE unit AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
    AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= {THRESHOLD}),
reach(v, r) AS (SELECT a, b FROM link UNION SELECT reach.v, link.b FROM reach JOIN link ON reach.r = link.a),
least AS (SELECT v, min(r) AS r FROM reach GROUP BY v),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(least.r, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(least.r, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN least ON e.vec_id = least.v LEFT JOIN n ON e.vec_id = n.a
"""
