"""Repeated substrings of a corpus from common-prefix interval trees.

Strings of ``length`` bytes are found wherever they start, without a list of all suffixes in one
place. Every such window of a text picks an anchor: the smallest hashed k-gram in it, the leftmost of
equals. Equal windows pick the same k-gram, so only windows with a common anchor can be equal.
Windows next to each other mostly share their anchor; the piece of text they cover is the unit that
is hashed, counted and compared. Anchors that occur once are dropped by the counts alone.

An anchor whose pieces are all equal needs no text: the piece is its one repeat. Of the pieces of any
other repeated anchor every distinct text is fetched once, with the number of its occurrences, and buckets of bounded size get an enhanced suffix array: the windows' suffixes up to the
piece's end in sorted order, with the lengths of common prefixes. A stack scan walks the tree of
common-prefix intervals. An interval of at least ``length`` bytes whose suffixes differ in the byte to
their left (or start their piece) is a maximal repeat: a group of all its occurrences, not just of
neighbours in the order. A text that occurs several times counts in its interval that often. Groups
cover their occurrences; what is covered goes back to every document that holds the piece.

An anchor of very many distinct pieces (the edge of a passage that a third of all documents share) is
split: its windows are counted one by one, and the repeated ones are compared by themselves.

Groups end where their piece does, so a repeat longer than an anchor's reach is several overlapping
groups; the bytes they cover are the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SLICE, Workspace, add_columns, table, tasks

LENGTH, GRAM = 200, 32
#: Distinct pieces of an anchor beyond which its windows are split, bytes of text in a bucket, windows numbered at a time.
CROWD, BUCKET_BYTES, BLOCK = 50_000, 1 << 20, 1 << 20
#: Symbols (a byte or the end of a piece, nine bits) in the first rank.
WORD = 7


def gram_hashes(text: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of every ``gram`` bytes; gram is a multiple of eight."""
    word, size = text.astype(np.uint64), 1
    while size < 8:
        word = (word[:-size] << np.uint64(8 * size)) | word[size:]
        size *= 2
    count = len(text) - gram + 1
    out = np.zeros(count, dtype=np.uint64)
    for at in range(0, gram, 8):
        out = (out ^ word[at : at + count]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9) ^ (out >> np.uint64(32))


def leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values, the position of its least one, the leftmost of equals."""
    place = np.uint64((1 << 24) - 1)
    marked = (values & ~place) | np.arange(len(values), dtype=np.uint64)  # the upper 40 bits decide, then the position
    count = len(values) - width + 1
    padded = np.concatenate([marked, np.full(-len(marked) % width, np.iinfo(np.uint64).max)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:count], ahead[width - 1 : width - 1 + count]) & place).astype(np.int64)


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, windows) of each anchor of a text; windows of one anchor follow each other."""
    found: list[tuple] = []
    data = np.frombuffer(text, dtype=np.uint8)
    for base in range(0, max(0, len(text) - length + 1), BLOCK):
        part = data[base : base + BLOCK + length - 1]
        hashes = gram_hashes(part, gram)
        least = leftmost_least(hashes, length - gram + 1)
        starts = np.flatnonzero(np.diff(least, prepend=-1))
        found.append((hashes[least[starts]].view(np.int64), base + starts, np.diff(starts, append=len(least))))
    if not found:
        return (np.zeros(0, dtype=np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*found))


def pieces_of(text: bytes, length: int, gram: int) -> Iterator[tuple[int, int, int, int]]:
    """(anchor, digest of the piece's text, first window, windows)."""
    for key, first, count in zip(*(c.tolist() for c in anchors(text, length, gram)), strict=True):
        yield key, xxhash.xxh64_intdigest(text[first : first + count + length - 1]) - (1 << 63), first, count


def _texts(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """(row, whole text, other columns) of packed texts."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            some = batch.slice(at, SLICE)
            for row, packed, *rest in zip(*(some.column(c) for c in ("row", "packed", *columns)), strict=True):
                yield row.as_py(), unpack(packed.as_py()), *(r.as_py() for r in rest)


def _pack():
    pack = zstandard.ZstdCompressor(level=3).compress

    def step(batch: pa.RecordBatch) -> list[list]:
        texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
        return [[len(t) for t in texts], [hashlib.sha256(t).hexdigest() for t in texts], [pack(t) for t in texts]]

    return step


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 8192) -> Iterator[pa.RecordBatch]:
    def batch(made: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*made), schema, strict=True)], schema=schema)

    made, size = [], 0
    for r in rows:
        made.append(r)
        size += sum(len(v) for v in r if isinstance(v, bytes))
        if len(made) == most or size > BUCKET_BYTES:
            yield batch(made)
            made, size = [], 0
    if made:
        yield batch(made)


ANCHOR = pa.schema([("row", pa.int64()), ("anchor", pa.int64()), ("digest", pa.int64()), ("first", pa.int64()), ("windows", pa.int32())])
PIECE = pa.schema([("anchor", pa.int64()), ("digest", pa.int64()), ("n", pa.int64()), ("crowd", pa.bool_()), ("piece", pa.binary())])
WINDOW = pa.schema([("anchor", pa.int64()), ("digest", pa.int64()), ("n", pa.int64()), ("at", pa.int32()), ("piece", pa.binary())])


class Suffixes:
    """An enhanced suffix array of the windows of some pieces, each with a number of occurrences.

    Pieces of different ``group`` hold no equal windows, so the groups' suffixes are sorted one after
    another. Suffixes that agree so far are sorted on by the word behind their common prefix, whose
    length comes from digests of doubling widths, so shared text costs no comparisons.
    """

    def __init__(self, pieces: list[bytes], copies: np.ndarray, length: int, group: np.ndarray | None = None):
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        starts = np.cumsum(sizes + 1) - sizes - 1
        symbols = np.zeros(int((sizes + 1).sum()), dtype=np.uint64)
        body = np.ones(len(symbols), dtype=bool)
        body[starts + sizes] = False
        symbols[body] = np.frombuffer(b"".join(pieces), dtype=np.uint8).astype(np.uint64) + np.uint64(1)  # 0 ends a piece
        windows = sizes - length + 1
        piece = np.repeat(np.arange(len(pieces)), windows)
        offset = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
        self.word = self._words(symbols)
        self.digests = [(WORD, self.word)]
        while self.digests[-1][0] * 2 <= int(sizes.max(initial=0)) + 1:
            width, half = self.digests[-1]
            right = np.concatenate([half[width:], np.zeros(min(width, len(half)), dtype=np.uint64)])
            mixed = (half ^ (half >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + right
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            self.digests.append((2 * width, mixed ^ (mixed >> np.uint64(32))))
        spot = starts[piece] + offset
        rest = sizes[piece] - offset
        kind = np.zeros(len(pieces), dtype=np.int64) if group is None else np.unique(group, return_inverse=True)[1]
        order = self._sorted(spot, rest, kind[piece])
        self.length, self.piece, self.offset, self.spot, self.rest = length, piece[order], offset[order], spot[order], rest[order]
        self.copies = copies[self.piece]
        self.left = np.where(self.offset > 0, symbols[self.spot - 1].astype(np.int64), -1)  # -1: the piece starts here
        self.common = np.zeros(len(order), dtype=np.int64)  # the prefix shared with the suffix before, as far as it matters
        width, digest = max((d for d in self.digests if d[0] <= length), key=lambda d: d[0], default=(0, None))
        together = kind[self.piece[1:]] == kind[self.piece[:-1]]
        if width:
            together &= digest[self.spot[1:]] == digest[self.spot[:-1]]
        pair = np.flatnonzero(together)
        self.common[pair + 1] = self._shared(self.spot[pair], self.spot[pair + 1], np.minimum(self.rest[pair], self.rest[pair + 1]))

    @staticmethod
    def _words(symbols: np.ndarray) -> np.ndarray:
        padded, word = np.concatenate([symbols, np.zeros(WORD, dtype=np.uint64)]), np.zeros(len(symbols), dtype=np.uint64)
        for k in range(WORD):
            word = (word << np.uint64(9)) | padded[k : k + len(symbols)]
        return word

    def _shared(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The length of the common prefix of the suffixes at a and b, ``most`` at the most."""
        same, last = np.zeros(len(a), dtype=np.int64), len(self.word) - 1
        at = lambda values, x: values[np.minimum(x + same, last)]
        for width, digest in reversed(self.digests):
            while True:
                equal = (at(digest, a) == at(digest, b)) & (same < most)
                same = same + width * equal
                if width != self.digests[-1][0] or not equal.any():
                    break
        x, y = at(self.word, a), at(self.word, b)
        for k in (4, 2, 1):
            equal = (x >> np.uint64(9 * (WORD - k))) == (y >> np.uint64(9 * (WORD - k)))
            same = same + k * equal
            x, y = (np.where(equal, (w << np.uint64(9 * k)) & np.uint64((1 << 63) - 1), w) for w in (x, y))
        return np.minimum(same, most)

    def _sorted(self, spot: np.ndarray, rest: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """The order of the suffixes by kind and text; suffixes of equal text in any order."""
        bits = int(kind.max(initial=0)).bit_length()
        key = (kind.astype(np.uint64) << np.uint64(63 - bits)) | (self.word[spot] >> np.uint64(bits))
        order = np.argsort(key)
        key = key[order]
        same = np.append(False, key[1:] == key[:-1])  # as the one before it, as far as is known
        active = np.flatnonzero(same | np.append(same[1:], False))
        run = np.cumsum(~same)[active]
        while len(active):
            mine = order[active]
            first = np.append(True, run[1:] != run[:-1])
            share = np.full(len(active), np.iinfo(np.int64).max)
            later = np.flatnonzero(~first)
            share[later] = self._shared(spot[mine[later - 1]], spot[mine[later]], np.minimum(rest[mine[later - 1]], rest[mine[later]]))
            heads = np.flatnonzero(first)
            depth = np.repeat(np.minimum.reduceat(share, heads), np.diff(heads, append=len(active)))
            ended = rest[mine] <= depth
            word = np.where(ended, np.uint64(0), self.word[np.minimum(spot[mine] + depth, len(self.word) - 1)])
            turn = np.lexsort((word, run))
            order[active], word, ended = mine[turn], word[turn], ended[turn]
            same = np.append(False, (run[1:] == run[:-1]) & (word[1:] == word[:-1]) & ~ended[1:])
            left = same | np.append(same[1:], False)
            run = np.cumsum(~same)[left]
            active = active[left]
        return order

    def intervals(self) -> Iterator[tuple[int, int, int]]:
        """(length, from, to) of the tree's intervals of at least the window's length, inner ones first; a suffix that occurs several times is one by itself."""
        common = np.append(self.common, 0)
        for i in np.flatnonzero((self.copies > 1) & (self.rest > common[:-1]) & (self.rest > common[1:])).tolist():
            yield int(self.rest[i]), i, i + 1
        stack: list[tuple[int, int]] = []
        deep = np.flatnonzero(common >= self.length)
        stops = np.unique(np.concatenate([deep, deep + 1]))  # elsewhere nothing is opened or closed
        for i in stops[stops < len(common)].tolist():
            value, start = int(common[i]), i - 1
            while stack and stack[-1][0] > value:
                width, start = stack.pop()
                yield width, start, i
            if value >= self.length and (not stack or stack[-1][0] < value):
                stack.append((value, start))

    def maximal(self) -> Iterator[tuple[int, int, int]]:
        """The intervals that no byte to the left extends."""
        found = np.array(list(self.intervals()), dtype=np.int64).reshape(-1, 3)
        start, last = found[:, 1], found[:, 2] - 1
        changes = np.cumsum(np.append(False, self.left[1:] != self.left[:-1]))  # of the left byte, from suffix to suffix
        begins = np.append(0, np.cumsum(self.left < 0))
        diverse = (changes[last] > changes[start]) | (begins[last + 1] > begins[start])
        yield from map(tuple, found[diverse].tolist())

    def cover(self) -> np.ndarray:
        """For each suffix, how far the longest maximal repeat that starts there reaches."""
        reach = np.zeros(len(self.spot), dtype=np.int64)
        for width, start, stop in self.maximal():
            np.maximum(reach[start:stop], width, out=reach[start:stop])
        return reach


def runs(start: np.ndarray, stop: np.ndarray) -> list[tuple[int, int]]:
    """The union of intervals, as disjoint ones in order."""
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    opens = np.flatnonzero(np.append(True, start[1:] > stop[:-1])) if len(start) else np.zeros(0, dtype=np.int64)
    return list(zip(start[opens].tolist(), stop[np.append(opens[1:] - 1, len(start) - 1)].tolist() if len(start) else [], strict=True))


def _covered(group: pa.Table, length: int) -> pa.Table:
    """(anchor, digest, start, stop) of what repeats cover in the pieces of one bucket."""
    pieces, copies = group.column("piece").to_pylist(), group.column("n").to_numpy()
    found = Suffixes(pieces, copies, length, group.column("anchor").to_numpy())
    reach = found.cover()
    some = np.flatnonzero(reach)
    some = some[np.argsort(found.piece[some], kind="stable")]
    out = []
    cuts = np.flatnonzero(np.diff(found.piece[some], prepend=-1, append=-1)) if len(some) else []
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        own = some[lo:hi]
        out += [(int(found.piece[own[0]]), a, b) for a, b in runs(found.offset[own], found.offset[own] + reach[own])]
    which = np.array([o[0] for o in out], dtype=np.int64)
    anchor, digest = (group.column(c).to_numpy()[which] for c in ("anchor", "digest"))
    return pa.table({"anchor": anchor, "digest": digest, "start": pa.array([o[1] for o in out], pa.int32()), "stop": pa.array([o[2] for o in out], pa.int32())})


def _groups(group: pa.Table, length: int) -> pa.Table:
    """The maximal repeats of one bucket, each with its occurrences as a range of the bucket's suffixes, and those suffixes."""
    found = Suffixes(group.column("piece").to_pylist(), group.column("n").to_numpy(), length, group.column("anchor").to_numpy())
    held = np.concatenate([[0], np.cumsum(found.copies)])
    rows = [("repeat", None, None, None, width, int(held[stop] - held[start]), start, stop) for width, start, stop in found.maximal()]
    named = found.cover() > 0
    anchor, digest = (group.column(c).to_pylist() for c in ("anchor", "digest"))
    rows += [("suffix", anchor[found.piece[i]], digest[found.piece[i]], int(found.offset[i]), None, None, int(i), None) for i in np.flatnonzero(named)]
    names = ["kind", "anchor", "digest", "offset", "length", "occurrences", "low", "high"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    columns = [pa.array([r[i] for r in rows], type=k) for i, k in enumerate(kinds)]
    return pa.table([pa.array([group.column("bucket")[0].as_py()] * len(rows), pa.int64()), *columns], names=["bucket", *names])


class Repeats:
    """The written tables of one search for repeated strings of ``length`` bytes.

    Null texts count as empty; texts shorter than the length hold no window. Rows are told apart by
    their number in the input, so repeated rows and equal or null ids are different documents.
    """

    def __init__(self, docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD, bucket_bytes: int = BUCKET_BYTES, text: str = "text"):
        self.spark, self.space = docs.sparkSession, Workspace(docs.sparkSession, "repeats")
        self.written, self.length, self.gram, self.crowd, self.bucket_bytes = 0, length, gram, crowd, bucket_bytes
        self.ids = [c for c in docs.columns if c != text]
        named = docs.select(*(F.col(c).alias(f"id_{i}") for i, c in enumerate(self.ids)), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))
        kept = [c for c in named.columns if c != "text"]
        new = {"n_bytes": pa.int64(), "sha256": pa.string(), "packed": pa.binary()}
        self.texts = self._write(add_columns(named, kept, new, _pack), "texts")
        self.anchors = self._write(self._found(), "anchors")
        distinct = self.anchors.groupBy("anchor", "digest").agg(F.count("*").alias("n"), F.min("row").alias("row"), F.min("windows").alias("windows"))
        self.distinct = self._write(distinct, "distinct")
        often = self.distinct.groupBy("anchor").agg(F.sum("n").alias("all"), F.count("*").alias("kinds"))
        self.often = self._write(often.where("all > 1").select("anchor", "kinds"), "often")

    def _write(self, frame: DataFrame, name: str) -> DataFrame:
        self.written += 1
        return self.space.write(frame, f"{name}-{self.written}")

    def _found(self) -> DataFrame:
        length, gram = self.length, self.gram

        def run(batches):
            return _batches(((row, *piece) for row, text in _texts(batches) for piece in pieces_of(text, length, gram)), ANCHOR)

        return self.texts.where(F.col("n_bytes") >= length).select("row", "packed").mapInArrow(run, "row long, anchor long, digest long, first long, windows int")

    def _fetched(self, least: int) -> DataFrame:
        """(anchor, digest, n, crowd, piece): the distinct pieces of each repeated anchor that has at least so many."""
        length, gram = self.length, self.gram
        asked = self.distinct.join(self.often.where(F.col("kinds") >= least).select("anchor", (F.col("kinds") > self.crowd).alias("crowd")), "anchor")
        asked = asked.groupBy("row").agg(F.collect_list(F.struct("anchor", "digest", "n", "crowd")).alias("asked"))  # at most a text's own pieces

        def run(batches):
            def rows():
                for _, text, wanted in _texts(batches, "asked"):
                    left = {(w["anchor"], w["digest"]): (w["n"], w["crowd"]) for w in wanted}
                    for anchor, digest, first, count in pieces_of(text, length, gram):
                        n, crowd = left.pop((anchor, digest), (0, False))
                        if n:
                            yield anchor, digest, n, crowd, text[first : first + count + length - 1]

            return _batches(rows(), PIECE)

        return self.texts.select("row", "packed").join(asked, "row").select("row", "packed", "asked").mapInArrow(run, "anchor long, digest long, n long, crowd boolean, piece binary")

    def _crowds(self, pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The windows of crowded anchors, and the distinct ones that occur twice or more as pieces of their own."""
        length = self.length

        def run(batches):
            def rows():
                for batch in batches:
                    for anchor, digest, n, piece in zip(*(batch.column(c).to_pylist() for c in ("anchor", "digest", "n", "piece")), strict=True):
                        for at in range(len(piece) - length + 1):
                            yield anchor, digest, n, at, piece[at : at + length]

            return _batches(rows(), WINDOW)

        crowded = pieces.where("crowd").select("anchor", "digest", "n", "piece")
        windows = self._write(crowded.mapInArrow(run, "anchor long, digest long, n long, at int, piece binary"), "windows")
        own = windows.groupBy("piece").agg(F.sum("n").alias("n")).where("n > 1")
        return windows, self._write(own.select(F.xxhash64("piece").alias("anchor"), F.xxhash64("piece", F.lit(1)).alias("digest"), "n", "piece"), "own")

    def _bucketed(self, pieces: DataFrame) -> DataFrame:
        size = pieces.agg(F.sum(F.octet_length("piece"))).first()[0] or 0
        return pieces.withColumn("bucket", F.pmod(F.xxhash64("anchor", F.lit(3)), F.lit(max(1, -(-size // self.bucket_bytes)))))

    def covered(self) -> DataFrame:
        """(anchor, digest, start, stop): what repeats cover in each distinct piece."""
        length, schema = self.length, "anchor long, digest long, start int, stop int"
        search = lambda pieces: self._bucketed(pieces).groupBy("bucket").applyInArrow(lambda t: _covered(t, length), schema)
        pieces = self._write(self._fetched(2), "pieces")
        alone = self.distinct.join(self.often.where("kinds = 1").select("anchor"), "anchor")
        alone = alone.select("anchor", "digest", F.lit(0).alias("start"), (F.col("windows") + (length - 1)).alias("stop"))
        plain = self._write(search(pieces.where("NOT crowd").select("anchor", "digest", "n", "piece")), "covered").unionByName(alone)
        if pieces.where("crowd").isEmpty():
            return plain
        windows, own = self._crowds(pieces)
        hit = self._write(search(own).where(F.col("stop") - F.col("start") >= length), "covered-windows")
        named = windows.select("anchor", "digest", "at", F.xxhash64("piece").alias("key"), F.xxhash64("piece", F.lit(1)).alias("second"))
        back = named.join(hit.select(F.col("anchor").alias("key"), F.col("digest").alias("second")), ["key", "second"])
        return plain.unionByName(back.select("anchor", "digest", F.col("at").alias("start"), (F.col("at") + length).alias("stop")))

    def spans(self) -> DataFrame:
        """(row, spans): for each document with repeats, the bytes they cover, as disjoint (start, stop) in order."""
        per_piece = self.covered().groupBy("anchor", "digest").agg(F.collect_list(F.struct("start", "stop")).alias("parts"))  # at most a piece's windows
        joined = self.anchors.join(self._write(per_piece, "per-piece"), ["anchor", "digest"])
        shift = F.transform("parts", lambda p: F.struct((F.col("first") + p["start"]).alias("start"), (F.col("first") + p["stop"]).alias("stop")))
        placed = self._write(joined.select("row", shift.alias("parts")), "placed")
        ordered = F.array_sort(F.flatten(F.collect_list("parts")))
        parts = placed.groupBy("row").agg(ordered.alias("parts"))

        def make():
            def step(batch: pa.RecordBatch) -> list[list]:
                out = []
                for parts in batch.column("parts"):
                    values = parts.values
                    found = runs(*(values.field(f).to_numpy(zero_copy_only=False) for f in ("start", "stop")))
                    out.append([{"start": a, "stop": b} for a, b in found])
                return [out]

            return step

        return add_columns(parts, ["row"], {"spans": pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))}, make)

    def groups(self) -> tuple[DataFrame, DataFrame]:
        """Maximal repeats (bucket, length, occurrences, low, high) and their suffixes (bucket, rank, row, position).

        The occurrences of a repeat are the suffixes of its bucket with low <= rank < high, each at
        every row and position where its piece stands, so their lists take room in proportion to the text.
        """
        length, schema = self.length, "bucket long, kind string, anchor long, digest long, offset int, length int, occurrences long, low long, high long"
        pieces = self._write(self._fetched(1).select("anchor", "digest", "n", "piece"), "all-pieces")
        found = self._bucketed(pieces).groupBy("bucket").applyInArrow(lambda t: _groups(t, length), schema)
        found = self._write(found, "groups")
        repeats = found.where("kind = 'repeat'").select("bucket", "length", "occurrences", "low", "high")
        suffixes = found.where("kind = 'suffix'").select("bucket", F.col("low").alias("rank"), "anchor", "digest", "offset")
        placed = suffixes.join(self.anchors, ["anchor", "digest"])
        return repeats, placed.select("bucket", "rank", "row", (F.col("first") + F.col("offset")).alias("position"))

    def kept(self) -> DataFrame:
        """(id columns of the documents, n_bytes, n_removed, n_spans, kept_sha256, body): every document without what repeats cover.

        body is the remaining text packed by zstd; null where nothing was removed.
        """
        spans = self._write(self.spans(), "spans")
        names = [f"id_{i}" for i in range(len(self.ids))]

        def make():
            unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=3).compress

            def step(batch: pa.RecordBatch) -> list[list]:
                removed, shas, bodies = [], [], []
                for packed, spans in zip(batch.column("packed"), batch.column("spans").to_pylist(), strict=True):
                    text, parts, at = unpack(packed.as_py()), [], 0
                    for s in spans:
                        parts.append(text[at : s["start"]])
                        at = s["stop"]
                    body = b"".join([*parts, text[at:]])
                    removed.append(len(text) - len(body))
                    shas.append(hashlib.sha256(body).hexdigest())
                    bodies.append(pack(body))
                return [removed, shas, bodies]

            return step

        cut = self.texts.select("row", "packed").join(spans, "row").withColumn("n_spans", F.size("spans").cast("long"))
        made = add_columns(cut, ["row", "n_spans"], {"n_removed": pa.int64(), "kept_sha256": pa.string(), "body": pa.binary()}, make)
        told = self.texts.drop("packed").join(made, "row", "left")
        return told.select(
            *(F.col(n).alias(c) for n, c in zip(names, self.ids, strict=True)),
            "n_bytes",
            F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
            F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
            F.coalesce("kept_sha256", "sha256").alias("kept_sha256"),
            "body",
        )


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).kept().drop("body")
