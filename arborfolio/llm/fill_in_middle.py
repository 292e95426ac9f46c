"""Fill-in-the-middle transformation by secondary-sort assembly.

A text is cut into lines; two positions hashed from the document's id split it into prefix, middle
and suffix. Each part is emitted as pieces of a bounded number of characters, cut between lines
where that is possible, and keyed by document and position in the output. ``repartition`` by
document and ``sortWithinPartitions`` by position (the DataFrame form of
repartitionAndSortWithinPartitions) bring them to a task in order, which streams them into an
incremental digest. For restoration the streamed pieces take the section that the last marker
opened, are sorted again in the same partitions by section, without another exchange, and streamed
into a second digest. No task holds more of a document than a piece.

Odd rows: a null text counts as empty and has form ``plain``; a null id is hashed as the seed and
colon alone; repeated rows are each transformed; an empty table gives an empty result; other
columns, whatever their names, are left out.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SLICE, ddl, table

#: The seed of the hashed draws, the percentage of texts transformed and of those in suffix-first form, the markers.
SEED, RATE, SPM = 7, 100, 50
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: Characters of a piece at most, and of the pieces that a task sends in one batch.
CHUNK, BATCH = 16_384, 1 << 20


def line_ends(text: str) -> list[int]:
    """Where each line ends: behind every line feed, and at the end of a text that has none there."""
    ends, at = [], text.find("\n")
    while at >= 0:
        ends.append(at + 1)
        at = text.find("\n", at + 1)
    if text and (not ends or ends[-1] < len(text)):
        ends.append(len(text))
    return ends


def draws(doc_id: int | None, seed: int) -> list[int]:
    """The four numbers that decide a document's form."""
    hexed = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(hexed[8 * i : 8 * i + 8], 16) for i in range(4)]


def plan(text: str, doc_id: int | None, seed: int, rate: int, spm: int) -> tuple[str, list[int], int, int]:
    """(form, line ends, end of the prefix, end of the middle)."""
    ends = line_ends(text)
    h = draws(doc_id, seed)
    if not text or h[2] % 100 >= rate or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return "plain", ends, 0, 0
    low, high = sorted((h[0] % (len(ends) + 1), h[1] % (len(ends) + 1)))
    return "spm" if h[3] % 100 < spm else "psm", ends, ends[low - 1] if low else 0, ends[high - 1] if high else 0


def cut(ends: list[int], start: int, stop: int, chunk: int) -> Iterator[tuple[int, int]]:
    """Pieces of ``start`` to ``stop``, which end at the last line end within reach, or at ``chunk`` characters in a longer line."""
    while start < stop:
        if stop - start <= chunk:
            end = stop
        else:
            k = bisect_right(ends, start + chunk)
            end = ends[k - 1] if k and ends[k - 1] > start else start + chunk
        yield start, end
        start = end


def sections(form: str, length: int, low: int, high: int) -> list[tuple[str, int, int]]:
    """(marker, start, stop) in the order of the output."""
    if form == "plain":
        return [("", 0, length)]
    prefix, middle, suffix = (PREFIX, 0, low), (MIDDLE, low, high), (SUFFIX, high, length)
    return [prefix, suffix, middle] if form == "psm" else [suffix, prefix, middle]


#: What is known of a document once its text has been read; it travels at position -1.
HEAD = {"doc_id": pa.int64(), "n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64()}
NOTHING = (None,) * len(HEAD)
#: Sections in the order of the restored text; what is known of a document comes after them.
ORDER = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
LAST = 3


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def _schema(names: dict[str, pa.DataType]) -> tuple[pa.Schema, str]:
    return pa.schema(list(names.items())), ", ".join(f"{n} {ddl(t)}" for n, t in names.items())


PIECE = {"row": pa.int64(), "place": pa.int64(), "body": pa.string(), **HEAD}


def pieces(numbered: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM, chunk: int = CHUNK) -> DataFrame:
    """(row, place, body, and at place -1 the columns of HEAD) from (row, doc_id, text)."""
    schema, ddl_of = _schema(PIECE)

    def of(row: int, doc_id: int | None, text: str) -> Iterator[tuple]:
        form, ends, low, high = plan(text, doc_id, seed, rate, spm)
        told = form != "plain"
        yield row, -1, None, doc_id, len(ends), form, low if told else None, high - low if told else None
        place = 0
        for marker, start, stop in sections(form, len(text), low, high):
            if marker:
                yield row, place, marker, *NOTHING
                place += 1
            for a, b in cut(ends, start, stop, chunk):
                yield row, place, text[a:b], *NOTHING
                place += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, size = [], 0
        for b in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            for row, doc_id, text in zip(*(b.column(c) for c in ("row", "doc_id", "text")), strict=True):
                for piece in of(row.as_py(), doc_id.as_py(), text.as_py() or ""):
                    made.append(piece)
                    size += 64 + len(piece[2] or "")
                    if size > BATCH:
                        yield _table(made, schema)
                        made, size = [], 0
        if made:
            yield _table(made, schema)

    return numbered.select("row", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ddl_of)


def in_order(found: DataFrame) -> DataFrame:
    """Each document's pieces in one partition, in the order of the output."""
    return found.repartition("row").sortWithinPartitions("row", "place")


def _rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield from zip(*(batch.column(c).slice(at, SLICE).to_pylist() for c in names), strict=True)


STREAMED = {"row": pa.int64(), "section": pa.int32(), "turn": pa.int64(), "body": pa.string(), **HEAD, "output_sha256": pa.string()}
DIGESTED = {"row": pa.int64(), **HEAD, "output_sha256": pa.string(), "restored_sha256": pa.string()}


def _stream_output(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest the output of each document and tell every piece's section by the marker before it."""
    schema, _ = _schema(STREAMED)
    made, size, row, head, digest, section, turn = [], 0, None, None, None, 0, 0
    for here, place, body, *about in _rows(batches, list(PIECE)):
        if place < 0:
            if row is not None:
                made.append((row, LAST, 0, None, *head, digest.hexdigest()))
            row, head, digest, section, turn = here, about, hashlib.sha256(), 0, 0
            continue
        digest.update(body.encode())
        if head[2] != "plain" and body in ORDER:
            section = ORDER[body]
            continue
        made.append((row, section, turn, body, *NOTHING, None))
        turn, size = turn + 1, size + 64 + len(body)
        if size > BATCH:
            yield _table(made, schema)
            made, size = [], 0
    if row is not None:
        made.append((row, LAST, 0, None, *head, digest.hexdigest()))
    yield _table(made, schema)


def _stream_restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema, _ = _schema(DIGESTED)
    made, digest = [], hashlib.sha256()
    for row, section, _, body, *about in _rows(batches, list(STREAMED)):
        if section != LAST:
            digest.update(body.encode())
            continue
        made.append((row, *about, digest.hexdigest()))
        digest = hashlib.sha256()
        if len(made) == 4096:
            yield _table(made, schema)
            made = []
    yield _table(made, schema)


def digests(found: DataFrame) -> DataFrame:
    """(row, doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of the documents of ``pieces``."""
    streamed = in_order(found).mapInArrow(_stream_output, _schema(STREAMED)[1])
    return streamed.sortWithinPartitions("row", "section", "turn").mapInArrow(_stream_restored, _schema(DIGESTED)[1])


def outputs(found: DataFrame) -> DataFrame:
    """(row, doc_id, n, form, prefix_chars, middle_chars, output): the transformed text of every document, which a task holds whole."""
    schema, ddl_of = _schema({"row": pa.int64(), **HEAD, "output": pa.string()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, head, parts = None, None, []
        for here, place, body, *about in _rows(batches, list(PIECE)):
            if place >= 0:
                parts.append(body)
                continue
            if row is not None:
                yield _table([(row, *head, "".join(parts))], schema)
            row, head, parts = here, about, []
        if row is not None:
            yield _table([(row, *head, "".join(parts))], schema)

    return in_order(found).mapInArrow(run, ddl_of)


def restored(transformed: DataFrame, output: str = "output", form: str = "form", into: str = "restored") -> DataFrame:
    """All columns and the text that each ``output`` was made of."""
    first, rest = (F.split_part(F.col(output), F.when(F.col(form) == "psm", SUFFIX).otherwise(PREFIX), F.lit(k)) for k in (1, 2))
    second, middle = (F.split_part(rest, F.lit(MIDDLE), F.lit(k)) for k in (1, 2))
    first = F.substring(first, 4, 2**31 - 1)
    text = F.when(F.col(form) == "psm", F.concat(first, middle, second)).when(F.col(form) == "spm", F.concat(second, middle, first)).otherwise(F.col(output))
    return transformed.withColumn(into, text)


def number(docs: DataFrame) -> DataFrame:
    """The documents with their row number; a frame that is not read from files should be written first, so that its rows keep theirs."""
    return docs.withColumn("row", F.monotonically_increasing_id())


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row of ``docs``."""
    return outputs(pieces(number(docs.select("doc_id", "text")), seed, rate, spm, chunk)).drop("row")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(pieces(number(table(spark, sf_dir, "documents").select("doc_id", "text")))).drop("row")


OP13_SQL = rf"""
WITH cut AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
         sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (
  SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS p1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS p2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS p3, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS p4 FROM cut),
formed AS (
  SELECT *, CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR p3 >= {RATE} THEN 'plain'
                 WHEN p4 < {SPM} THEN 'spm' ELSE 'psm' END AS form,
         coalesce(array_to_string(u[1:least(p1, p2)], ''), '') AS pre, coalesce(array_to_string(u[least(p1, p2) + 1:greatest(p1, p2)], ''), '') AS mid,
         coalesce(array_to_string(u[greatest(p1, p2) + 1:], ''), '') AS suf FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid
              ELSE '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE pre || mid || suf END) AS restored_sha256
FROM formed
"""
