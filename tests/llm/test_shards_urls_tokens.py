import base64
import hashlib
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from arborfolio.llm import byte_bpe, packing, sharding, url_filter

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def odd_docs(spark):
    long = "aé " * 3000 + "x" * 2000 + "  \n\t " * 400 + "don't I'll " * 900
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "Hello  world", "en", "s", 1), (4, long, None, "s", 2), (4, long, None, "s", 2), (5, " ", "fr", None, 3), (6, "a" * 30_000, "fr", None, 3)]
    return spark.createDataFrame(rows, DOCS)


def tik():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return path, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_equals_library(spark):
    path, own = tik()
    for docs in (odd_docs(spark), spark.read.parquet(f"{SF}/documents.parquet")):
        got = byte_bpe.encode(docs.select("doc_id", "text"), path, chunk=700, overlap=60).collect()
        want = [(r.doc_id, own.encode_ordinary(r.text or "")) for r in docs.collect()]
        assert sorted(((r.doc_id, list(r.ids)) for r in got), key=str) == sorted(want, key=str)


def test_byte_bpe_query_and_round_trip(spark):
    _, own = tik()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in byte_bpe.op9_byte_bpe(spark, SF).collect():
        ids = own.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_decode(spark):
    path, own = tik()
    ids = own.encode_ordinary("naïve café")
    frame = spark.createDataFrame([(1, ids), (2, []), (3, None)], "k int, ids array<int>")
    assert [bytes(r.bytes).decode() for r in byte_bpe.decode(frame, path).orderBy("k").collect()] == ["naïve café", "", ""]


def check_packed(rows, docs, path, window=2048):
    tokenizer = Tokenizer.from_file(path)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for doc_id, text in docs.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert sorted(by_seq) == list(range(len(by_seq)))
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    return 1 - sum(r.length for r in rows) / (window * len(by_seq))


def test_packing_places_every_id_once(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert check_packed(packing.op6_packing(spark, SF).collect(), docs, path) < 0.05


def test_packing_odd_rows(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack_documents(odd_docs(spark), path).collect()
    assert sum(r.doc_id == 4 and r.start == 0 for r in rows) == 2
    assert any(r.doc_id is None for r in rows) and any(r.doc_id == 1 and r.length == 1 for r in rows)
    assert packing.pack_documents(odd_docs(spark).where("false"), path).count() == 0


def test_packing_ids_are_the_library_s(spark):
    path, rng = public_tokenizers.path("word_bpe_49k.json"), np.random.default_rng(4)
    marks = ["<|endoftext|>", "<|startoftext|>", "<|endoftext", "Don't", "I'LL", "é", "ß", "\u00a0", "\t", "\n", " ", " ", "x1y22", "...", "##a", "日本", "e\u0301", "İ", "\u2028", "word", "Words"]
    docs = {i: "".join(rng.choice(marks, rng.integers(0, 12))) for i in range(400)}
    rows = packing.pack_documents(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), path).collect()
    check_packed(rows, docs, path)


def test_packing_with_another_tokenizer_file(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert not packing.WordEncoder(path).fits
    docs = {1: "Hello  world, it's <|endoftext|> here\n", 2: None}
    check_packed(packing.pack_documents(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), path).collect(), docs, path)


def test_packing_hot_length(spark):
    pieces = spark.range(5000).selectExpr("id", "if(id % 3 = 0, 700L, id % 2048 + 1) length")
    rows = packing.pack(pieces).collect()
    by_seq = defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert len(rows) == 5000 and len({r.id for r in rows}) == 5000
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(r.length for r in rows) / (2048 * len(by_seq)) > 0.88


def test_nonnegative_least_squares():
    a = np.array([[1.0, 0, 1], [0, 2, 1], [1, 1, 0]])
    x = np.array([2.0, 0, 3])
    assert np.allclose(packing.nonnegative_least_squares(a, a @ x), x)


@pytest.mark.parametrize("shards", [1, 4, 16])
def test_sharding_law(spark, shards):
    docs = odd_docs(spark).unionByName(spark.read.parquet(f"{SF}/documents.parquet"))
    rows = sharding.shuffle_into_shards(docs, shards, bucket_bytes=50_000).collect()
    assert sorted(((r.doc_id, r.text) for r in rows), key=str) == sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    sizes = [len(slots[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_sharding_query(spark):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = sharding.op7_sharding(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    sizes = [sum(r.shard == s for r in rows) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(docs)
    for s in range(16):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    for r in rows:
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(docs[r.doc_id]) + 1, zlib.crc32(docs[r.doc_id]), "rows", None)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, sharding.op7_sharding(spark, SF).collect()))


def test_sharding_spreads_equal_rows_and_takes_groups_of_buckets(spark, tmp_path):
    spark.range(0, 4000, 1, 4).selectExpr("'same' text", "map('k', 1) m").write.parquet(str(tmp_path / "same"))
    same = spark.read.parquet(str(tmp_path / "same"))
    numbered = same.select(F.monotonically_increasing_id().alias("n"))
    sizes = [r["count"] for r in numbered.groupBy(F.pmod(F.xxhash64(F.lit(7), "n"), F.lit(20))).count().collect()]
    assert len(sizes) == 20 and max(sizes) < 300
    for group in (16_384, 6):
        rows = sharding.shuffle_into_shards(same, 3, bucket_bytes=14_000, group_buckets=group).collect()
        assert sorted((r.shard, r.slot) for r in rows) == [(s, i) for s, n in ((0, 1334), (1, 1333), (2, 1333)) for i in range(n)]


def test_sharding_mixes_and_takes_few_or_no_rows(spark):
    rows = sharding.shuffle_into_shards(spark.range(2000).selectExpr("id", "'t' text", "1 shard"), 4).collect()
    first = sorted((r.slot, r.id) for r in rows if r.shard == 0)
    ids = [i for _, i in first]
    assert abs(np.corrcoef(range(len(ids)), ids)[0, 1]) < 0.2 and abs(np.mean(ids) - 1000) < 100
    few = spark.createDataFrame(odd_docs(spark).limit(3).collect(), DOCS)
    assert sharding.shuffle_into_shards(few, 16).count() == 3
    assert sharding.shuffle_into_shards(few.where("false"), 16).count() == 0


def test_url_rules(spark):
    urls = ["http://WWW.Example.com/en/1", "https://example.com/en/x?y", "http://m.example.com/fr/", "http://a.net/es/1", "http://a.net/es", "http://xnet/es/", "net://net/fr/#a", "nothing", None, "http://com", "http://badexample.com/en/"]
    pages = spark.createDataFrame([(i if i else None, u, "z") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    rules = spark.createDataFrame([*url_filter.RULES, (None, "/", "block")], "host string, path string, verdict string")
    got = {(r.page_id): (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules).collect()}
    assert got == {
        None: ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        1: ("example.com", "/en/x", "example.com/en/", "block"),
        2: ("m.example.com", "/fr/", "com/", "allow"),
        3: ("a.net", "/es/1", "net/es/", "block"),
        4: ("a.net", "/es", None, "allow"),
        5: ("xnet", "/es/", None, "allow"),
        6: ("net", "/fr/", "net/fr/", "block"),
        7: ("", "", None, "allow"),
        8: ("", "", None, "allow"),
        9: ("com", "", None, "allow"),
        10: ("badexample.com", "/en/", "com/", "allow"),
    }
    assert url_filter.judge_urls(pages.where("false"), rules).count() == 0
    sharded = url_filter.build_index(spark, rules, shard_bytes=60)
    assert len(sharded["shards"]) > 1


@pytest.mark.parametrize("shard_bytes", [1 << 20, 40])
def test_of_equally_long_rules_that_of_the_longer_host_wins(spark, monkeypatch, shard_bytes):
    pages = spark.createDataFrame([(1, "http://a.com/ab"), (2, "http://b.com/ab"), (3, "http://x.a.com/")], "page_id long, url string")
    for verdicts in (("block", "allow"), ("allow", "block")):
        rules = spark.createDataFrame([("com", "/ab", verdicts[0]), ("a.com", "/", verdicts[1]), ("om", "/abc", "block")], "host string, path string, verdict string")
        build = url_filter.build_index
        with monkeypatch.context() as patch:
            patch.setattr(url_filter, "build_index", lambda s, r: build(s, r, shard_bytes=shard_bytes))
            got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules).collect()}
        assert got == {1: ("a.com/", verdicts[1]), 2: ("com/ab", verdicts[0]), 3: ("a.com/", verdicts[1])}


def test_url_rules_with_long_hosts(spark):
    host = "a." * 50_000 + "example.com"
    pages = spark.createDataFrame([(1, f"http://{host}/en/x"), (2, f"http://{host}x/en/x"), (3, "http://." + "/" * 100_000), (4, "://com" + "/en" * 30_000)], "page_id long, url string")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules).collect()}
    assert got == {1: ("example.com/en/", "block"), 2: (None, "allow"), 3: (None, "allow"), 4: ("com/", "allow")}


def test_url_query_equals_its_sql(spark):
    known = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.op8_url_filter(spark, SF).collect()}
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    assert known == set(duck.sql(url_filter.OP8_SQL).fetchall())
