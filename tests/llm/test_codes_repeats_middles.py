import hashlib
import os
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from arborfolio.llm import fill_in_middle, suffix_dedup, vector_codes

SF = "/root/testdata/sf0.001"


def by_sql(sql):
    connection = duckdb.connect()
    for name in ("documents", "embeddings"):
        path = f"{SF}/{name}.parquet"
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    found = connection.execute(sql)
    return [d[0] for d in found.description], found.fetchall()


@pytest.mark.parametrize("query, sql", [(vector_codes.op11_vector_codes, vector_codes.OP11_SQL), (fill_in_middle.op13_fill_in_middle, fill_in_middle.OP13_SQL)])
def test_query_equals_sql(spark, query, sql):
    names, want = by_sql(sql)
    assert sorted(map(tuple, query(spark, SF).select(names).collect()), key=str) == sorted(want, key=str)


# codes of vectors


def plain_codes(rows, parts, entries, rounds):
    """(code, error) of each row and the codebooks, entry by entry; rows of (id, whole numbers)."""
    first = [v for _, v in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]]
    dims = len(rows[0][1])
    cuts = [(dims * i // parts, dims * (i + 1) // parts) for i in range(parts)]
    books = [[v[lo:hi] for v in first] for lo, hi in cuts]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda part, book: min((far(part, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p, (lo, hi) in enumerate(cuts):
            held = [[] for _ in books[p]]
            for _, v in rows:
                held[near(v[lo:hi], books[p])[1]].append(v[lo:hi])
            books[p] = [[sum(c) // len(own) for c in zip(*own)] if own else e for own, e in zip(held, books[p], strict=True)]
    best = [[near(v[lo:hi], books[p]) for p, (lo, hi) in enumerate(cuts)] for _, v in rows]
    return [(bytes(b[1] for b in row), sum(b[0] for b in row)) for row in best], books


def test_masks_leave_every_nearest_entry():
    rng = np.random.default_rng(3)
    for count, dims, spread in [(1, 3, 5), (7, 2, 3), (64, 4, 40), (256, 16, 300), (300, 1, 50)]:
        entries = rng.integers(-spread, spread + 1, (count, dims))
        points = rng.integers(-2 * spread, 2 * spread + 1, (500, dims))
        far = ((points[:, None] - entries) ** 2).sum(axis=2)
        book = vector_codes.Codebook(entries)
        entry, least = book.nearest(points)
        assert (entry == far.argmin(axis=1)).all() and (least == far.min(axis=1)).all()
        masks = book.candidates(points, least)
        inside = [[bool(int(m[k // 64]) >> (k % 64) & 1) for k in range(count)] for m in masks]
        assert (np.array(inside) >= (far <= least[:, None])).all()
    assert vector_codes.Codebook(np.zeros((2, 0), dtype=np.int64)).nearest(np.zeros((3, 0), dtype=np.int64))[0].tolist() == [0, 0, 0]


VECTORS = "vec_id long, embedding array<float>, label int, dims string"


def test_codes_equal_plain_rounds(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i) if i % 9 else None, [float(x) for x in rng.normal(size=6)], int(i % 3) if i % 5 else None, "kept") for i in rng.permutation(60)]
    rows += rows[:4] + [(3, rows[7][1], 1, "kept")]
    odd = [(900, None, 1, "a"), (901, [float("nan")] * 6, 1, "a"), (902, [1.0, None] * 3, 1, "a"), (903, [float("inf")] * 6, 1, "a"), (904, [3e38] * 6, 1, "a")]
    kept = vector_codes.whole_steps(spark.createDataFrame(rows + odd, VECTORS).repartition(3))
    assert kept.count() == len(rows)
    books = vector_codes.fit(kept, parts=4, entries=8, rounds=3)
    got = vector_codes.with_label_error(vector_codes.encode(kept, books)).collect()
    steps = [(r[0], [int(np.floor(np.float32(x).astype(float) * 1024)) for x in r[1]]) for r in rows]
    want, plain_books = plain_codes(steps, 4, 8, 3)
    assert [b.tolist() for b in books[6]] == plain_books
    error_of = Counter()
    for r, (_, e) in zip(rows, want, strict=True):
        error_of[r[2]] += e
    assert sorted(((r.vec_id, r.label, bytes(r.code), r.error, r.label_error, r.dims) for r in got), key=str) == sorted(
        ((r[0], r[2], c, e, error_of[r[2]], "kept") for r, (c, e) in zip(rows, want, strict=True)), key=str
    )
    back = vector_codes.decode(vector_codes.encode(kept, books), books, 6).collect()
    first = next(r for r in back if r.vec_id == rows[1][0] and r.label == rows[1][2])
    assert first.approximate == [(books[6][p][first.code[p]][k] + 0.5) / 1024 for p, n in enumerate((1, 2, 1, 2)) for k in range(n)]


def test_codes_of_other_lengths_and_label_shares(spark, monkeypatch):
    rows = [(i, [0.5 * i] * (4 if i % 2 else 8), i % 2, "x") for i in range(20)] + [(50, [], 7, "x")]
    kept = vector_codes.whole_steps(spark.createDataFrame(rows, VECTORS))
    books = vector_codes.fit(kept, entries=4, rounds=1)
    assert sorted(books) == [0, 4, 8]
    encoded = vector_codes.encode(kept, books)
    whole = sorted(map(tuple, vector_codes.with_label_error(encoded).collect()))
    assert [r for r in whole if r[0] == 50] == [(50, 7, "x", b"\0\0\0\0", 0, 0)]
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 0)
    assert sorted(map(tuple, vector_codes.with_label_error(encoded).collect())) == whole
    none = vector_codes.whole_steps(spark.createDataFrame([], VECTORS))
    assert vector_codes.encode(none, vector_codes.fit(none)).collect() == []


# repeated strings


def plain_repeats(texts, length):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text, window by window."""
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        covered = np.zeros(len(t) + 1, dtype=bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                covered[i : i + length] = True
        kept = bytes(b for b, c in zip(t, covered, strict=False) if not c)
        out.append((len(t), int(covered.sum()), int((np.diff(covered.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def odd_texts():
    rng = np.random.default_rng(9)
    words = lambda n: " ".join(rng.choice(["alpha", "béta", "gamma", "delta", "epsilon", "zeta\n", "eta", "\x00"], n))
    common, long = words(90), words(3000)
    texts = [None, "", "short", common, common, words(40) + common + words(30), common[40:320] + words(25), long, long[:5000] + "!" + long[5001:], long[100:400] * 3]
    texts += ["a" * 199, "a" * 200, "a" * 450, "ab" * 300, "\x00" * 250, *(words(12) + common[:260] + words(8) for _ in range(40))]
    return texts


@pytest.mark.parametrize("settings", [{}, {"crowd": 3, "bucket_bytes": 5000}, {"gram": 8}])
def test_repeats_equal_windows_counted_one_by_one(spark, settings):
    texts = odd_texts()
    rows = [(i if i % 7 else None, t, f"row {i}", "packed") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, packed string").repartition(4)
    got = suffix_dedup.Repeats(docs, **settings).kept().collect()
    want = plain_repeats([(t or "").encode() for t in texts], 200)
    ids = sorted((str(r.doc_id), r.row, r.packed, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)
    assert ids == sorted((str(r[0]), r[2], r[3], *w) for r, w in zip(rows, want, strict=True))
    assert sum(w[1] for w in want) > 5000 and sum(w[2] for w in want) > 50


def test_repeats_of_the_tables(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    want = plain_repeats([(d["text"] or "").encode() for d in docs], 200)
    got = sorted(map(tuple, suffix_dedup.op12_suffix_dedup(spark, SF).collect()))
    assert got == sorted((d["doc_id"], *w) for d, w in zip(docs, want, strict=True))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.Repeats(empty).kept().collect() == []


def test_blocks_of_a_long_text_change_nothing(monkeypatch):
    rng = np.random.default_rng(2)
    text = bytes(rng.integers(97, 100, 5000, dtype=np.uint8)) + b"x" * 500
    whole = [c.tolist() for c in suffix_dedup.anchors(text)]
    monkeypatch.setattr(suffix_dedup, "BLOCK", 700)
    keys, first, count = (c.tolist() for c in suffix_dedup.anchors(text))
    window = lambda k, f, n: [(i, a) for a, s, c in zip(k, f, n, strict=True) for i in range(s, s + c)]
    assert window(keys, first, count) == window(*whole)


def test_interval_tree_gives_all_maximal_repeats():
    rng = np.random.default_rng(4)
    for length in (3, 8):
        pieces = [bytes(rng.integers(97, 99, int(n), dtype=np.uint8)) for n in rng.integers(length, 40, 30)]
        copies = rng.integers(1, 3, len(pieces))
        spots = [(p, i) for p, t in enumerate(pieces) for i in range(len(t) - length + 1)]
        by_string = {}
        for p, i in spots:
            for stop in range(i + length, len(pieces[p]) + 1):
                by_string.setdefault(pieces[p][i:stop], []).append((p, i))
        want = set()
        for string, places in by_string.items():
            n = sum(copies[p] for p, _ in places)
            left = {pieces[p][i - 1] if i else ("start", p) for p, i in places}
            right = Counter()
            for p, i in places:
                right[pieces[p][i + len(string)] if i + len(string) < len(pieces[p]) else ("end", p)] += int(copies[p])
            ends = any(isinstance(r, tuple) for r in right)
            if n > 1 and (len(right) > 1 or ends) and (len(left) > 1 or any(isinstance(x, tuple) for x in left)):
                want.add((len(string), tuple(sorted(places))))
        found = suffix_dedup.Suffixes(pieces, copies, length)
        got = {(w, tuple(sorted(zip(found.piece[a:b].tolist(), found.offset[a:b].tolist())))) for w, a, b in found.maximal()}
        assert got == want and len(got) > 20


def test_groups_name_all_occurrences(spark):
    texts = odd_texts()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    found = suffix_dedup.Repeats(docs, bucket_bytes=20_000)
    repeats, suffixes = found.groups()
    text_of = {r.row: (texts[r.id_0] or "").encode() for r in found.texts.select("row", "id_0").collect()}
    placed = suffixes.collect()
    assert repeats.count() > 10
    for g in repeats.collect():
        held = {(s.row, s.position) for s in placed if s.bucket == g.bucket and g.low <= s.rank < g.high}
        strings = {text_of[row][at : at + g.length] for row, at in held}
        assert len(strings) == 1 and len(held) == g.occurrences > 1 and len(strings.pop()) == g.length >= 200


# fill in the middle


def plain_middle(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < spm:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("settings", [{}, {"chunk": 5}, {"seed": 8, "rate": 40, "spm": 60, "chunk": 64}])
def test_middles_equal_plain_cutting(spark, settings, monkeypatch):
    monkeypatch.setattr(fill_in_middle, "BATCH", 500)
    rng = np.random.default_rng(6)
    lines = lambda n: "".join(rng.choice(["one\n", "two words\n", "é😀x\n", "\n", "tail<", "S>", "a long line without any end in sight\n"], n))
    rows = [(None, None), (1, None), (2, ""), (3, "\n"), (4, "\n\n"), (5, "x"), (6, "has <M> in it\nno"), (7, "y" * 3000 + "\n" + "z" * 50), (7, "y" * 3000 + "\n" + "z" * 50)]
    rows += [(int(i), lines(int(n))) for i, n in enumerate(rng.integers(1, 60, 60), 10)] + [(None, lines(9))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    key = {k: settings[k] for k in ("seed", "rate", "spm") if k in settings}
    want = [(i, *plain_middle(i, t, **key)) for i, t in rows]
    made = fill_in_middle.fill_in_middle(docs, **settings)
    columns = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert sorted(map(tuple, made.select(columns).collect()), key=str) == sorted(want, key=str)
    assert {w[2] for w in want} == {"plain", "spm", "psm"}
    back = fill_in_middle.restored(made).select("doc_id", "restored").collect()
    assert sorted(map(tuple, back), key=str) == sorted([(i, t or "") for i, t in rows], key=str)
    numbered = fill_in_middle.number(docs)
    told = fill_in_middle.digests(fill_in_middle.pieces(numbered, **settings))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    sums = [(*w[:5], sha(w[5]), sha(t or "")) for w, (_, t) in zip(want, rows, strict=True)]
    assert sorted(map(tuple, told.select(*columns[:5], "output_sha256", "restored_sha256").collect()), key=str) == sorted(sums, key=str)


def test_pieces_are_bounded_and_cut_at_lines(spark):
    text = "".join(f"line {i}\n" for i in range(400)) + "w" * 700
    numbered = fill_in_middle.number(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    bodies = [r.body for r in fill_in_middle.pieces(numbered, chunk=100).where("place >= 0").orderBy("place").collect()]
    whole = [b for b in bodies if b not in ("<P>", "<S>", "<M>")]
    assert max(map(len, whole)) <= 100 and sum(map(len, whole)) == len(text)
    assert all(b.endswith("\n") for b in whole if b.startswith("line"))
    plan = fill_in_middle.digests(fill_in_middle.pieces(numbered))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert fill_in_middle.digests(fill_in_middle.pieces(numbered.where("false"))).count() == 0


def test_columns_kept_of_repeats_may_clash(spark):
    docs = spark.createDataFrame([(1, "q" * 300, "a", 5)], "doc_id long, text string, n_spans string, n_bytes int")
    row = suffix_dedup.Repeats(docs.withColumnRenamed("n_spans", "sha").withColumnRenamed("n_bytes", "id_0")).kept().first()
    assert (row.doc_id, row.sha, row.id_0, row.n_removed, row.n_spans) == (1, "a", 5, 300, 1)
