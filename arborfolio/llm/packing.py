"""Packing documents into fixed windows by non-negative least squares over length combinations.

Documents longer than the window are cut at multiples of it; every other document stays whole. The
histogram of piece lengths (at most one row per length) is the only thing that reaches the driver.
There, combinations of up to three length bins that fill the window are enumerated, repeat counts
are solved against the histogram by non-negative least squares and rounded, and what is left is
packed greedily, longest first, again on the histogram. The plan, a bounded table, is joined back:
the k-th piece of a length takes the k-th place the plan has for that length.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .shared import Workspace, add_columns, table

WINDOW, END_ID, BINS, DEPTH = 2048, 1, 128, 3
#: Pieces of one length that are ranked in one task, about.
RANKED_ROWS = 200_000
CACHED_WORDS = 300_000

_loaded: dict[str, WordEncoder] = {}

#: Words of printable ASCII and Latin-1 letters only; for them the parts below are what the tokenizer makes.
PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z\u00df-\u00f6\u00f8-\u00ff0-9]+")


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


#: How tokenizer files that the word cache fits normalise a text and cut it into words.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class WordEncoder:
    """Ids of a text as bytes, as the tokenizer's own ``encode`` gives them, by a cache of the ids of words between spaces.

    The tokenizer turns white space into boundaries that no token crosses, so the ids of a text are
    those of its words in order. Of a plain word, each run of letters, digit or run of other marks is
    looked up on its own, and only unknown runs go to the tokenizer's model; any other word, and one
    that holds a special token, goes through the whole tokenizer. A full cache is emptied. A file
    that normalises or cuts texts in another way is used without the cache, on whole texts.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        added = told.get("added_tokens") or []
        plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) and not re.search(r"\s", t["content"]) for t in added)
        self.fits = plain and told["normalizer"] == NORMALIZER and told["pre_tokenizer"] == PRE_TOKENIZER and not (told.get("post_processor") or told.get("truncation"))
        self.added = re.compile("|".join(re.escape(t["content"]) for t in added) or "(?!)")
        self.model, self.letters = self.tokenizer.model, str.maketrans({b: c for b, c in byte_letters().items()})
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    @staticmethod
    def of(path: str) -> WordEncoder:
        """One for each Python worker."""
        if path not in _loaded:
            _loaded[path] = WordEncoder(path)
        return _loaded[path]

    def _part(self, part: str) -> bytes:
        mapped = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        ids = self.parts[part] = np.array([t.id for t in self.model.tokenize(mapped)], dtype="<u4").tobytes()
        return ids

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if not PLAIN.fullmatch(word) or self.added.search(word):
            return self._whole(word)
        known = self.parts
        return b"".join([known[p] if p in known else self._part(p) for p in PARTS.findall(word.lower())])

    def __call__(self, text: str) -> bytes:
        if not self.fits:
            return self._whole(text)
        words = text.replace("\n", " ").split(" ")
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:
            if len(self.known) > CACHED_WORDS:
                self.known, self.parts = {}, {}
            for word in set(words):
                if word not in self.known:
                    self.known[word] = self._word(word)
            return b"".join(map(self.known.__getitem__, words))


PIECE = pa.struct([(n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens")])


def _cutter(path: str, window: int):
    encode, end = WordEncoder.of(path), np.array([END_ID], dtype="<u4").tobytes()

    def cut(text: str | None) -> list[dict]:
        ids = encode(text or "") + end
        parts = [(at // 4, ids[at : at + 4 * window]) for at in range(0, len(ids), 4 * window)]
        return [{"start": at, "length": len(p) // 4, "ids_crc32": zlib.crc32(p), "doc_tokens": len(ids) // 4} for at, p in parts]

    return lambda batch: [[cut(t) for t in batch.column("text").to_pylist()]]


def cut_pieces(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) for every piece of every document."""
    cut = add_columns(docs.select("doc_id", "text"), ["doc_id"], {"piece": pa.list_(PIECE)}, lambda: _cutter(path, window))
    return cut.select("doc_id", F.inline("piece"))


def combinations(bins: int, depth: int) -> list[tuple[int, ...]]:
    """All falling tuples of up to ``depth`` bin numbers (1 to bins) that sum to ``bins``."""
    found, open_ = [], [((), bins, bins)]
    while open_:
        head, left, most = open_.pop()
        for x in range(min(left, most), 0, -1):
            if x == left:
                found.append((*head, x))
            elif len(head) + 1 < depth and x * (depth - len(head)) >= left:
                open_.append(((*head, x), left - x, x))
    return sorted(found)


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Lawson and Hanson's active-set method on the normal equations."""
    gram, target = a.T @ a, a.T @ b
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], dtype=bool)
    for _ in range(rounds):
        slope = target - gram @ x
        slope[active] = -np.inf
        if slope.max() <= 1e-7 * max(1.0, abs(target).max()):
            break
        active[slope.argmax()] = True
        while True:
            on = np.flatnonzero(active)
            trial = np.linalg.lstsq(gram[np.ix_(on, on)], target[on], rcond=None)[0]
            if (trial > 1e-12).all():
                x[:] = 0
                x[on] = trial
                break
            low = trial <= 1e-12
            step = min(1.0, (x[on][low] / np.maximum(x[on][low] - trial[low], 1e-300)).min())
            x[on] += step * (trial - x[on])
            active[on[x[on] <= 1e-12]] = False
            x[~active] = 0
            if not active.any():
                break
    return x


def plan(histogram: dict[int, int], window: int = WINDOW, bins: int = BINS, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths in one sequence, how many such sequences)], placing every piece of ``histogram``."""
    left = {n: c for n, c in histogram.items() if c > 0}
    full = left.pop(window, 0)
    made = [((window,), full)] if full else []
    width = window // bins
    by_bin = np.zeros(bins + 1)
    for n, c in left.items():
        by_bin[-(-n // width)] += c
    ways = [w for w in combinations(bins, depth) if len(w) > 1 and all(by_bin[x] for x in set(w))]
    if ways:
        a = np.zeros((bins + 1, len(ways)))
        for j, way in enumerate(ways):
            for x in way:
                a[x, j] += 1
        counts = np.rint(nonnegative_least_squares(a, by_bin)).astype(int)
        stock: dict[int, list[int]] = {}
        for n in sorted(left):
            stock.setdefault(-(-n // width), []).append(n)
        for j in np.argsort(-counts, kind="stable"):
            made += _take(ways[j], int(counts[j]), stock, left)
    return made + _greedy(left, window)


def _take(way: tuple[int, ...], times: int, stock: dict[int, list[int]], left: dict[int, int]) -> list[tuple[tuple[int, ...], int]]:
    """Fill ``times`` sequences of one combination, longest lengths of each bin first, while stock lasts."""
    made = []
    while times > 0:
        lengths, need = [], {}
        for x in way:
            n = next((n for n in reversed(stock.get(x, [])) if left[n] > need.get(n, 0)), None)
            if n is None:
                return made
            lengths.append(n)
            need[n] = need.get(n, 0) + 1
        several = min([times, *(left[n] // k for n, k in need.items())])
        for n, k in need.items():
            left[n] -= k * several
        for x in set(way):
            while stock[x] and left[stock[x][-1]] == 0:
                stock[x].pop()
        made.append((tuple(lengths), several))
        times -= several
    return made


def _greedy(left: dict[int, int], window: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest first; each sequence is filled with the longest piece that still fits. Works on counts."""
    left, made = {n: c for n, c in left.items() if c}, []
    while left:
        lengths, room, need = [], window, {}
        for n in sorted(left, reverse=True):
            k = min(room // n, left[n])
            if k:
                lengths += [n] * k
                need[n] = k
                room -= n * k
        several = min(left[n] // k for n, k in need.items())
        made.append((tuple(lengths), several))
        for n, k in need.items():
            left[n] -= k * several
            if not left[n]:
                del left[n]
    return made


def pack(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """All columns of ``pieces`` and sequence_id (gapless from 0) and offset (gapless in a sequence).

    Needs a column length from 1 to ``window``. Pieces of one length are told apart by a salted rank,
    so a very common length is not ranked in one task. An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    keys = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    pieces = pieces.select(*keys).withColumn("__salt", F.pmod(F.xxhash64(*keys), F.lit(8 + pieces.count() // RANKED_ROWS)))
    cells = pieces.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
    histogram: dict[int, int] = {}
    for row in cells.groupBy("length").agg(F.sum("__n").alias("n")).collect():
        histogram[row["length"]] = row["n"]
    places, base = [], 0
    used: dict[int, int] = {}
    for lengths, times in plan(histogram, window):
        for n in sorted(set(lengths), reverse=True):
            k = lengths.count(n)
            places.append((n, used.get(n, 0), used.get(n, 0) + k * times, base, k, sum(x for x in lengths if x > n)))
            used[n] = used.get(n, 0) + k * times
        base += times
    schema = "length long, __from long, __to long, __base long, __k long, __at long"
    table_ = spark.createDataFrame(places, schema)
    ahead = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("length", "__salt", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("length", "__salt").orderBy(*keys)) - 1
    ranked = pieces.withColumn("__in", rank).join(offsets, ["length", "__salt"]).withColumn("__rank", F.col("__before") + F.col("__in"))
    on = (F.col("p.length") == F.col("t.length")) & (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__to"))
    placed = ranked.alias("p").join(F.broadcast(table_).alias("t"), on)
    turn = F.col("__rank") - F.col("__from")
    return placed.select(
        *(F.col(f"p.{c}") for c in keys),
        (F.col("__base") + F.expr("(__rank - __from) div __k")).alias("sequence_id"),
        (F.col("__at") + (turn % F.col("__k")) * F.col("p.length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """Cut and pack whole documents; a null text counts as empty, repeated rows are packed each."""
    return pack(Workspace(docs.sparkSession, "packing").write(cut_pieces(docs, path, window), "pieces"), window)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
