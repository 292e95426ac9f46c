"""Byte-level BPE encoding of whole texts by overlapping chunks, and decoding.

A text is cut into chunks that overlap. Every chunk is pre-tokenised on its own, by any task. The
pre-token pattern never looks back, so two neighbouring chunks agree on everything after a position
where both have a boundary: the first such position in the overlap is the seam. Pieces between
seams hold whole pre-tokens, and the ids of a text are the ids of its pieces in order. Where an
overlap has no common boundary, the rest of that text is encoded as one piece. Decoding concatenates
the raw bytes of the ids.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Workspace, add_columns, table

CHUNK, OVERLAP = 32_768, 512

_loaded: dict[str, tuple] = {}


def encoding(path: str) -> tuple[tiktoken.Encoding, list[str]]:
    """The encoding of a rank file, once per Python worker, and the decimal text of each id."""
    if path not in _loaded:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        own = tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _loaded[path] = own, [str(i) for i in range(max(ranks.values()) + 1)]
    return _loaded[path]


def cut(text: str, chunk: int, overlap: int) -> list[tuple[int, str]]:
    """(start, chunk text); a chunk reaches ``overlap`` characters into the next one."""
    return [(i, text[i : i + chunk + overlap]) for i in range(0, max(1, len(text)), chunk)]


def boundaries(text: str, chunk: int, overlap: int, start: int, first: bool, last: bool) -> tuple[list[int], list[int]]:
    """Pre-token ends in the overlap with the previous chunk and in the one with the next chunk.

    The last pre-tokens of a cut chunk may go on beyond it, so ends that touch the cut don't count.
    """
    ends = [m.end() for m in regex.finditer(public_tokenizers.PATTERN, text)]
    if not last:
        ends = [e for e in ends if e + 1 < len(text)]
    head = [] if first else [start + e for e in ends if e <= overlap]
    tail = [] if last else [start + e for e in ends if e >= chunk]
    return head, tail


def _chunks(batches: Iterator[pd.DataFrame], chunk: int, overlap: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row, text in zip(batch["__row"], batch["text"], strict=True):
            parts = cut(text, chunk, overlap)
            for at in range(0, len(parts), 256):
                some = parts[at : at + 256]
                yield pd.DataFrame({"__row": row, "__chunk": range(at, at + len(some)), "__chunks": len(parts), "__start": [s for s, _ in some], "__text": [t for _, t in some]})


def _seams(batches: Iterator[pd.DataFrame], chunk: int, overlap: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [boundaries(t, chunk, overlap, s, c == 0, c + 1 == n) for t, s, c, n in zip(batch["__text"], batch["__start"], batch["__chunk"], batch["__chunks"], strict=True)]
        yield pd.DataFrame({"__row": batch["__row"], "__chunk": batch["__chunk"], "__head": [h for h, _ in found], "__tail": [t for _, t in found]})


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate([*arrays, np.zeros(0, np.int32)]).astype(np.int32))


def _with_ids(frame: DataFrame, keep: list[str], path: str) -> DataFrame:
    def make():
        own, _ = encoding(path)
        return lambda b: [_lists([own.encode_to_numpy(t, disallowed_special=()) for t in b.column("__text").to_pylist()])]

    return add_columns(frame, keep, {"ids": pa.list_(pa.int32())}, make)


def encode(docs: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """The columns of ``docs`` but ``text``, and ``ids`` array<int>: the ids of the whole text.

    A null or empty text has no ids. Repeated rows are each encoded. A column named ids is replaced.
    """
    kept = [c for c in docs.columns if c not in ("ids", "text")]
    short = F.coalesce(F.char_length("text"), F.lit(0)) <= chunk
    whole = docs.where(short).select(*kept, F.coalesce("text", F.lit("")).alias("__text"))
    whole = _with_ids(whole, kept, path)
    long = docs.where(~short).withColumn("__row", F.monotonically_increasing_id())
    long = Workspace(docs.sparkSession, "long-texts").write(long, "rows")  # numbered once, whatever is computed again
    encoded = _encode_long(long.select("__row", "text"), path, chunk, overlap)
    return whole.unionByName(long.select("__row", *kept).join(encoded, "__row").drop("__row"))


def pieces_of(long: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(__row, __chunk, __text): the pieces of each text, which start and end at pre-token boundaries."""
    chunks = long.mapInPandas(
        lambda b: _chunks(b, chunk, overlap), "__row long, __chunk int, __chunks int, __start long, __text string"
    ).repartition("__row", "__chunk")
    bounds = chunks.mapInPandas(lambda b: _seams(b, chunk, overlap), "__row long, __chunk int, __head array<long>, __tail array<long>")
    order = Window.partitionBy("__row").orderBy("__chunk")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seams = (
        bounds.withColumn("__lo", F.array_min(F.array_intersect(F.lag("__tail").over(order), F.col("__head"))))
        .withColumn("__lost", F.max((F.col("__lo").isNull() & (F.col("__chunk") > 0)).cast("int")).over(so_far))
        .withColumn("__piece", F.when(F.col("__lost") == 0, F.col("__chunk")))
        .withColumn("__piece", F.max("__piece").over(so_far))
        .withColumn("__hi", F.lead(F.when(F.col("__lost") == 0, F.col("__lo"))).over(order))
        .select("__row", "__chunk", "__piece", F.coalesce(F.when(F.col("__lost") == 0, F.col("__lo")), F.lit(0)).alias("__lo"), "__hi", "__lost")
    )
    joined = chunks.join(seams, ["__row", "__chunk"])
    begin = F.when((F.col("__lost") == 0) & (F.col("__chunk") > 0), F.col("__lo") - F.col("__start")).otherwise(F.lit(0))
    end = F.when(F.col("__hi").isNotNull(), F.col("__hi") - F.col("__start")).when(
        F.col("__chunk") + 1 == F.col("__chunks"), F.char_length("__text")
    ).otherwise(F.lit(chunk))
    cut_out = joined.select("__row", "__chunk", "__piece", F.col("__text").substr((begin + 1).cast("int"), (end - begin).cast("int")).alias("__text"))
    single = cut_out.groupBy("__row", "__piece").agg(F.count("*").alias("__n"), F.sort_array(F.collect_list(F.struct("__chunk", "__text"))).alias("__parts"))
    return single.select("__row", F.col("__piece").alias("__chunk"), F.concat_ws("", F.col("__parts.__text")).alias("__text"))


def _encode_long(long: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    ids = _with_ids(pieces_of(long, chunk, overlap), ["__row", "__chunk"], path)
    ordered = F.sort_array(F.collect_list(F.struct("__chunk", "ids")))
    return ids.groupBy("__row").agg(F.flatten(F.transform(ordered, lambda p: p["ids"])).alias("ids"))


def decode(tokens: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """All columns of ``tokens`` and ``bytes``: the raw bytes of the ids, concatenated."""
    def make():
        own, _ = encoding(path)
        return lambda b: [[own.decode_bytes(x.as_py() or []) for x in b.column(ids)]]

    return add_columns(tokens, [c for c in tokens.columns if c != "bytes"], {"bytes": pa.binary()}, make)


def _digests(path: str):
    own, names = encoding(path)

    def one(ids: list[int]) -> tuple[int, str, str]:
        listed = ",".join([names[i] for i in ids]).encode()
        return len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(own.decode_bytes(ids)).hexdigest()

    def run(batch: pa.RecordBatch) -> list[list]:
        found = [one(x.values.to_pylist()) for x in batch.column("ids")]
        return [[f[k] for f in found] for k in range(3)]

    return run


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    new = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    return add_columns(encoded, ["doc_id"], new, lambda: _digests(path))
