"""SimHash near-dedup with BK-trees.

Fingerprints within ``radius`` differing bits are linked. Distinct fingerprints are dealt to shards:
the 64 bits are cut into blocks, and two fingerprints within the radius agree on all bits of at
least ``blocks - radius`` of them, so a shard holds the fingerprints that agree on one such choice
of blocks. Every shard is a BK-tree: children are keyed by their integer Hamming distance to the
parent, and a search follows only edges within the radius of the distance to the node. A shard's
tree is built where Spark's shuffle brings its rows together, not broadcast, since a broadcast of
all trees would carry every fingerprint through the driver.

A shard gives links that connect all it found within reach, not all pairs, so a large group of near
copies costs one link for each member.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import components
from .shared import Workspace, add_columns, table, tasks

SHINGLE, RADIUS, SEED = 4, 4, 42
#: A shard of more distinct fingerprints than this is dealt over tiles, each holding two of its parts.
SHARD_ROWS = 4096
TASK_ROWS = 200_000

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles; zero for a text without words."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    hashes = np.array([digest(join(words[i : i + size]), SEED) for i in range(max(1, len(words) - size + 1))], dtype=">u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def _fingerprints():
    return lambda batch: [np.array([fingerprint(t) for t in batch.column("text").to_pylist()], dtype=np.uint64).view(np.int64).tolist()]


class BKTree:
    """A BK-tree over distinct 64-bit fingerprints; whole arrays of searches go down it together."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        children: list[dict[int, int]] = [{} for _ in prints]
        values = prints.tolist()
        for i in range(1, len(values)):
            node = 0
            while True:
                edge = (values[i] ^ values[node]).bit_count()
                below = children[node].get(edge)
                if below is None:
                    children[node][edge] = i
                    break
                node = below
        starts, edges, nodes = [0], [], []
        for kids in children:
            edges += kids.keys()
            nodes += kids.values()
            starts.append(len(nodes))
        self.starts, self.edges, self.nodes = np.array(starts), np.array(edges, dtype=np.int16), np.array(nodes, dtype=np.int64)

    def near(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """All (query position, node) within the radius."""
        hits: list[tuple[np.ndarray, np.ndarray]] = []
        who, node = np.arange(len(queries)), np.zeros(len(queries), dtype=np.int64)
        while len(who):
            far = np.bitwise_count(queries[who] ^ self.prints[node]).astype(np.int16)
            hit = far <= radius
            hits.append((who[hit], node[hit]))
            fan = self.starts[node + 1] - self.starts[node]
            at = np.repeat(self.starts[node] - np.cumsum(fan) + fan, fan) + np.arange(fan.sum())
            parent = np.repeat(np.arange(len(who)), fan)
            follow = np.abs(self.edges[at] - far[parent]) <= radius
            who, node = who[parent[follow]], self.nodes[at[follow]]
        return np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])


def shard_links(prints: np.ndarray, radius: int, step: int = 256) -> np.ndarray:
    """For each of the distinct ``prints``, the position of the first one in its group of links."""
    parent = np.arange(len(prints))
    tree = BKTree(prints)
    for at in range(0, len(prints), step):
        who, node = tree.near(prints[at : at + step], radius)
        who = who + at
        keep = node < who
        who, node = who[keep], node[keep]
        while True:  # hook larger roots under smaller ones and shorten paths until nothing moves
            a, b = parent[who], parent[node]
            if (a == b).all():
                break
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            while (parent != (up := parent[parent])).any():
                parent = up
    return parent


def _blocks(count: int) -> list[tuple[int, int]]:
    """(lowest bit, mask) of each block."""
    cuts = [64 * i // count for i in range(count + 1)]
    return [(lo, (1 << (hi - lo)) - 1) for lo, hi in zip(cuts, cuts[1:])]


def choose_blocks(rows: int, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> int:
    """The fewest blocks whose shards hold about ``shard_rows`` fingerprints at most."""
    blocks = radius + 1
    while rows / 2 ** (64 * (blocks - radius) / blocks) > shard_rows / 4 and blocks < radius + 4:
        blocks += 1
    return blocks


def links(prints: DataFrame, rows: int, space: Workspace, radius: int = RADIUS) -> DataFrame:
    """(a, b): links among the distinct fingerprints ``prints`` (column fp long) that connect all within the radius."""
    count = choose_blocks(rows, radius)
    bits = _blocks(count)
    keys = [
        F.xxhash64(F.lit(i), *(F.shiftrightunsigned(F.col("fp"), bits[b][0]).bitwiseAND(F.lit(bits[b][1])) for b in choice))
        for i, choice in enumerate(combinations(range(count), count - radius))
    ]
    dealt = prints.select("fp", F.explode(F.array(*keys)).alias("shard"))
    crowded = space.write(dealt.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > SHARD_ROWS), "crowded")
    if not crowded.isEmpty():
        parts = crowded.select("shard", F.ceil(F.col("n") / (SHARD_ROWS // 2)).cast("int").alias("parts"))
        own = F.pmod(F.xxhash64("fp", F.lit(SEED)), F.col("parts")).cast("int")
        tiles = dealt.join(parts, "shard", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", own)
        tiles = tiles.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        dealt = tiles.select("fp", F.xxhash64("shard", F.least("own", "other"), F.greatest("own", "other")).alias("shard"))
    dealt = dealt.repartition(max(8 * tasks(prints.sparkSession), rows * len(keys) // TASK_ROWS), "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column("fp").to_numpy(), b.column("shard").to_numpy()) for b in batches]
        if not parts:
            return
        fp, shard = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        order = np.lexsort((fp, shard))
        fp, shard = fp[order], shard[order]
        cuts = np.flatnonzero(np.diff(shard, prepend=shard[:1] - 1, append=shard[-1:] + 1))
        for lo, hi in zip(cuts, cuts[1:]):
            if hi - lo > 1:
                own = fp[lo:hi]
                first = shard_links(own.view(np.uint64), radius)
                moved = np.flatnonzero(first != np.arange(len(own)))
                if len(moved):
                    yield pa.RecordBatch.from_arrays([pa.array(own[first[moved]]), pa.array(own[moved])], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_copies(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, the columns ``keep``, fp, group, component_id) for every row: equal or near fingerprints share a group.

    component_id is the smallest doc_id reachable over links (null only if all are). Null, empty and
    wordless texts have fingerprint zero and link like any other. Repeated rows stay repeated.
    """
    spark, space, keep = docs.sparkSession, Workspace(docs.sparkSession, "simhash"), ["doc_id", *(keep or [])]
    printed = space.write(add_columns(docs.select(*keep, "text"), keep, {"fp": pa.int64()}, _fingerprints), "prints")
    distinct = space.write(printed.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = space.write(links(distinct, distinct.count(), space, radius), "links")
    groups = components(found)
    member = distinct.join(groups, distinct["fp"] == groups["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("group"))
    least = member.groupBy("group").agg(F.min("least").alias("component_id"))
    return printed.join(member.join(least, "group").select("fp", "group", "component_id"), "fp").select(*keep, "fp", "group", "component_id")


def one_of_each(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row, all columns as they are, of each group of near copies: that of the smallest doc_id.

    Rows that share an id are told apart by their other columns; a row without an id stays only if
    its whole group has none.
    """
    names = {c: f"__{i}" for i, c in enumerate(docs.columns)}  # apart from the columns added here
    plain = [F.to_json(F.struct(c)) if "map<" in docs.schema[c].dataType.simpleString() else F.col(c) for c in docs.columns]
    marked = docs.select(F.xxhash64(*plain).alias("mark"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), *(F.col(c).alias(n) for c, n in names.items()))
    known = near_copies(marked.select("mark", "doc_id", "text"), size, radius, ["mark"])
    first = known.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("first")).select("first.doc_id", "first.mark")
    chosen = marked.alias("d").join(first.alias("f"), F.expr("d.mark = f.mark AND d.doc_id <=> f.doc_id"), "left_semi")
    turn = F.row_number().over(Window.partitionBy("doc_id", "mark").orderBy(F.lit(0)))
    return chosen.withColumn("turn", turn).where("turn = 1").select(*(F.col(n).alias(c) for c, n in names.items()))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
