"""Compression of vectors to short codes, nearest codebook entries by slice-and-intersect bitmasks.

Vectors become whole numbers and are cut into equal consecutive parts; each part position has a
codebook. The entries' coordinates are sorted in every dimension, and each place in that order
carries a mask of the entries before it. A part's initial radius is its distance to the best of the
entries next to it in one dimension each, which no nearest entry can exceed. In every dimension the
radius selects a slice of the sorted coordinates, whose entries are the difference of two prefix
masks; the slices' uint64 masks are ANDed, and what is left is a complete list of candidates, whose
distances are compared exactly.

A round is one pass over the written vectors: every task assigns its parts and adds them up by
entry, Spark adds the tasks' sums, and the new codebooks (a fixed number of entries) are made on the
driver and mapped by all executors.

Vectors of different length have codebooks of their own. Rows whose vector is null or holds a null,
non-finite or too large component (MOST) are dropped. Rows without an id come after all others when
first entries are picked, and rows that share an id are ordered by their vectors. With fewer rows
than entries every row is an entry. Repeated rows stay repeated; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Workspace, add_columns, mapped, publish, table

#: Parts of a vector, entries of a codebook, rounds, steps a unit.
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Components beyond this many steps would overflow 64-bit sums of squares.
MOST = 1 << 26
#: Label totals up to this many are broadcast (rows of a label and a number); beyond, each total is sent to so many shares of its label's rows.
BROADCAST_LABELS, SHARES = 200_000, 32
#: Parts whose distances are computed at a time.
STEP = 4096


def part_cuts(dims: int, parts: int) -> list[tuple[int, int]]:
    cuts = [dims * i // parts for i in range(parts + 1)]
    return list(zip(cuts, cuts[1:]))


class Codebook:
    """Entries (rows of int64) with sorted coordinates and prefix masks in each dimension."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        count, dims = entries.shape
        self.words = (count + 63) // 64
        self.order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.ascontiguousarray(np.take_along_axis(entries, self.order, axis=0).T)
        bit = np.zeros((count, self.words), dtype=np.uint64)
        bit[np.arange(count), np.arange(count) // 64] = np.uint64(1) << (np.arange(count) % 64).astype(np.uint64)
        self.prefix = np.zeros((dims, count + 1, self.words), dtype=np.uint64)
        for d in range(dims):
            self.prefix[d, 1:] = np.bitwise_or.accumulate(bit[self.order[:, d]], axis=0)

    def reach(self, points: np.ndarray) -> np.ndarray:
        """A squared distance within which each point has an entry: the best of its neighbours in each dimension's order."""
        best = np.full(len(points), np.iinfo(np.int64).max)
        for d in range(points.shape[1]):
            at = np.searchsorted(self.sorted[d], points[:, d])
            for near in (np.clip(at - 1, 0, None), np.clip(at, None, len(self.entries) - 1)):
                gap = points - self.entries[self.order[near, d]]
                best = np.minimum(best, np.einsum("ij,ij->i", gap, gap))
        return best

    def candidates(self, points: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """Masks of the entries within the radius of each point in every dimension."""
        radius = np.floor(np.sqrt(reach.astype(np.float64))).astype(np.int64) + 1
        left = np.full((len(points), self.words), np.iinfo(np.uint64).max, dtype=np.uint64)
        for d in range(points.shape[1]):
            lo = np.searchsorted(self.sorted[d], points[:, d] - radius, side="left")
            hi = np.searchsorted(self.sorted[d], points[:, d] + radius, side="right")
            left &= self.prefix[d, hi] ^ self.prefix[d, lo]
        return left

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each point; ties go to the lower entry."""
        entry, far = np.zeros(len(points), dtype=np.int64), np.zeros(len(points), dtype=np.int64)
        if not points.shape[1]:
            return entry, far
        for at in range(0, len(points), STEP):
            some = points[at : at + STEP]
            masks = self.candidates(some, self.reach(some))
            bits = np.unpackbits(masks.astype("<u8").view(np.uint8).reshape(len(some), -1), axis=1, bitorder="little", count=len(self.entries))
            who, which = np.nonzero(bits)  # by point, then by entry
            starts = np.searchsorted(who, np.arange(len(some)))
            found = np.empty(len(who), dtype=np.int64)
            for lo in range(0, len(who), 1 << 16):
                gap = some[who[lo : lo + (1 << 16)]] - self.entries[which[lo : lo + (1 << 16)]]
                found[lo : lo + (1 << 16)] = np.einsum("ij,ij->i", gap, gap)
            least = np.minimum.reduceat(found, starts)
            first = np.flatnonzero(found == np.repeat(least, np.diff(starts, append=len(who))))
            first = first[np.unique(who[first], return_index=True)[1]]
            entry[at : at + STEP], far[at : at + STEP] = which[first], least
        return entry, far


Books = dict[int, list[np.ndarray]]


def _open(name: str, shapes: dict[int, list[tuple[int, int]]]) -> dict[int, list[Codebook]]:
    """The published codebooks of every vector length."""
    flat, books, at = mapped(name, "entries", np.int64), {}, 0
    for dims, sizes in shapes.items():
        books[dims] = []
        for rows, width in sizes:
            books[dims].append(Codebook(flat[at : at + rows * width].reshape(rows, width)))
            at += rows * width
    return books


def _publish(space: Workspace, books: Books) -> tuple[str, dict]:
    shapes = {dims: [b.shape for b in parts] for dims, parts in books.items()}
    flat = np.concatenate([b.ravel() for parts in books.values() for b in parts] + [np.zeros(0, dtype=np.int64)])
    return publish(space, {"entries": flat}) if len(flat) else "", shapes


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(vector length, row numbers, their vectors) of a batch with a list column ``steps``."""
    column = batch.column("steps")
    sizes, flat = column.value_lengths().to_numpy(zero_copy_only=False), column.flatten().to_numpy()
    starts = np.cumsum(sizes) - sizes
    for dims in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dims)
        yield dims, rows, flat[starts[rows][:, None] + np.arange(dims)].astype(np.int64)


SUMS = pa.schema([("dims", pa.int64()), ("part", pa.int64()), ("entry", pa.int64()), ("count", pa.int64()), ("sums", pa.list_(pa.int64()))])


def _adder(name: str, shapes: dict, parts: int) -> Callable:
    """Assign every part of a task's vectors and add them up by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = _open(name, shapes)
        sums = {(dims, p): np.zeros((len(b.entries), b.entries.shape[1] + 1), dtype=np.int64) for dims, own in books.items() for p, b in enumerate(own)}
        for batch in batches:
            for dims, _, vectors in _by_length(batch):
                for p, (lo, hi) in enumerate(part_cuts(dims, parts)):
                    entry, _ = books[dims][p].nearest(vectors[:, lo:hi])
                    order = np.argsort(entry, kind="stable")
                    used, first = np.unique(entry[order], return_index=True)
                    total = sums[dims, p]
                    total[used, 0] += np.diff(first, append=len(order))
                    if hi > lo:
                        total[used, 1:] += np.add.reduceat(vectors[order, lo:hi], first, axis=0)
        for (dims, p), total in sums.items():
            used = np.flatnonzero(total[:, 0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(([dims] * len(used), [p] * len(used), used, total[used, 0], total[used, 1:].tolist()), SUMS, strict=True)], schema=SUMS
            )

    return run


def _moved(kept: DataFrame, books: Books, space: Workspace, parts: int) -> Books:
    """The codebooks after one round."""
    name, shapes = _publish(space, books)
    added = kept.select("steps").mapInArrow(_adder(name, shapes, parts), "dims long, part long, entry long, count long, sums array<long>")
    key = ["dims", "part", "entry"]
    wide = added.select(*key, F.posexplode(F.concat(F.array("count"), "sums")).alias("at", "value"))
    summed = wide.groupBy(*key, "at").agg(F.sum("value").alias("value")).toArrow()  # one row for each component of each entry
    new = {dims: [b.copy() for b in own] for dims, own in books.items()}
    dims, part, entry, at, value = (summed.column(c).to_numpy() for c in (*key, "at", "value"))
    order = np.lexsort((at, entry, part, dims))
    dims, part, entry, value = dims[order], part[order], entry[order], value[order]
    for start in np.flatnonzero(at[order] == 0):
        book = new[int(dims[start])][int(part[start])]
        book[entry[start]] = value[start + 1 : start + 1 + book.shape[1]] // value[start]
    return new


def first_books(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> Books:
    """The parts of the vectors of the smallest ids, for each vector length."""
    books: Books = {}
    for dims in [r[0] for r in kept.select(F.size("steps")).distinct().collect()]:
        own = kept.where(F.size("steps") == dims).orderBy(F.col("vec_id").asc_nulls_last(), "steps").limit(entries).select("steps").collect()
        chosen = np.array([r[0] for r in own], dtype=np.int64).reshape(len(own), dims)
        books[dims] = [np.ascontiguousarray(chosen[:, lo:hi]) for lo, hi in part_cuts(dims, parts)]
    return dict(sorted(books.items()))


def whole_steps(frame: DataFrame, scale: int = SCALE) -> DataFrame:
    """The rows that take part, with ``embedding`` replaced by ``steps``: floor(scale * component)."""
    steps = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * scale < MOST))
    kept = frame.where(F.col("embedding").isNotNull()).where(sound)
    return kept.withColumn("steps", steps.cast("array<int>")).drop("embedding")


def fit(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Books:
    """Codebooks of the rows of ``whole_steps``, by vector length and part."""
    space, books = Workspace(kept.sparkSession, "codebooks"), first_books(kept, parts, entries)
    for _ in range(rounds if books else 0):
        books = _moved(kept, books, space, parts)
    return books


def encode(kept: DataFrame, books: Books) -> DataFrame:
    """The columns of ``kept`` but steps, code (binary, a byte a part for up to 256 entries, else two) and error long."""
    name, shapes = _publish(Workspace(kept.sparkSession, "codes"), books)
    parts = len(next(iter(shapes.values()), []))
    wide = any(rows > 256 for sizes in shapes.values() for rows, _ in sizes)

    def make():
        own = _open(name, shapes)

        def step(batch: pa.RecordBatch) -> list[list]:
            codes, errors = np.zeros((batch.num_rows, parts), dtype=">u2" if wide else np.uint8), np.zeros(batch.num_rows, dtype=np.int64)
            for dims, rows, vectors in _by_length(batch):
                for p, (lo, hi) in enumerate(part_cuts(dims, parts)):
                    entry, far = own[dims][p].nearest(vectors[:, lo:hi])
                    codes[rows, p] = entry
                    errors[rows] += far
            return [[c.tobytes() for c in codes], errors.tolist()]

        return step

    keep = [c for c in kept.columns if c not in ("steps", "code", "error")]
    return add_columns(kept, keep, {"code": pa.binary(), "error": pa.int64()}, make)


def decode(codes: DataFrame, books: Books, dims: int, scale: int = SCALE) -> DataFrame:
    """All columns of ``codes`` and ``approximate``, the vector of its entries' middles, for vectors of one length."""
    name, shapes = _publish(Workspace(codes.sparkSession, "codes"), {dims: books[dims]})

    def make():
        own = _open(name, shapes)[dims]

        def step(batch: pa.RecordBatch) -> list[list]:
            found = np.array([list(c.as_py()) for c in batch.column("code")], dtype=np.int64).reshape(batch.num_rows, len(own))
            return [((np.hstack([b.entries[found[:, p]] for p, b in enumerate(own)]) + 0.5) / scale).tolist()]

        return step

    return add_columns(codes, [c for c in codes.columns if c != "approximate"], {"approximate": pa.list_(pa.float64())}, make)


def books_sha256(parts: list[np.ndarray]) -> str:
    """The digest of all entries' components by part, entry and position."""
    return hashlib.sha256(",".join(str(v) for part in parts for v in part.ravel().tolist()).encode()).hexdigest()


def with_label_error(encoded: DataFrame, label: str = "label") -> DataFrame:
    """All columns and label_error: error summed over rows of the same label, nulls together (null beyond a long)."""
    marked = encoded.withColumn("__label", F.struct(label))
    totals = marked.groupBy("__label").agg(F.try_sum("error").alias("label_error"))
    totals = Workspace(encoded.sparkSession, "labels").write(totals, "totals")
    if totals.count() <= BROADCAST_LABELS:
        return marked.join(F.broadcast(totals), "__label").drop("__label")
    share = F.pmod(F.xxhash64("code", "error", *[c for c in encoded.columns if c == "vec_id"]), F.lit(SHARES))
    dealt = totals.withColumn("__share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))))
    return marked.withColumn("__share", share).join(dealt, ["__label", "__share"]).drop("__label", "__share")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark, "vector-codes")
    kept = space.write(whole_steps(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")), "kept")
    books = fit(kept)
    encoded = space.write(encode(kept.withColumn("dims", F.size("steps")), books), "encoded")
    said = spark.createDataFrame([(dims, books_sha256(own)) for dims, own in books.items()], "dims int, codebooks_sha256 string")
    told = with_label_error(encoded).join(F.broadcast(said), "dims")
    return told.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", "codebooks_sha256")


def _sql() -> str:
    """The rounds as chained views over (id, part, components), with entries as (part, entry, components)."""
    far = "list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(f"""near{k} AS MATERIALIZED (SELECT p.id, p.part, arg_min(struct_pack(e := b.entry, d := coalesce({far}, 0)), coalesce({far}, 0) * {ENTRIES} + b.entry) AS best
  FROM piece p JOIN book{k} b ON p.part = b.part GROUP BY p.id, p.part)""")
        if k < ROUNDS:
            steps.append(f"""book{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN (
    SELECT part, entry, list(floor_of ORDER BY pos) AS x FROM (
      SELECT p.part, n.best.e AS entry, s.pos, CAST(floor(CAST(sum(p.x[s.pos]) AS DOUBLE) / count(*)) AS BIGINT) AS floor_of
      FROM piece p JOIN near{k} n ON p.id = n.id AND p.part = n.part, (SELECT unnest(range(1, (SELECT max(len(x)) + 1 FROM piece))) AS pos) s
      WHERE s.pos <= len(p.x) GROUP BY ALL) GROUP BY part, entry) m ON b.part = m.part AND b.entry = m.entry)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, label, list_transform(embedding, lambda v: CAST(floor(CAST(v AS DOUBLE) * {SCALE}) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
piece AS MATERIALIZED (
  SELECT id, part, x[len(x) * part // {PARTS} + 1:len(x) * (part + 1) // {PARTS}] AS x FROM kept, range({PARTS}) r(part)),
book0 AS MATERIALIZED (SELECT part, id - 1 AS entry, x FROM piece WHERE id <= {ENTRIES}),
{", ".join(steps)},
coded AS (
  SELECT id, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY id),
said AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, said.codebooks_sha256
FROM kept k JOIN coded c ON k.id = c.id, said
"""


OP11_SQL = _sql()
