"""URL filtering by a sorted digest array.

Rules (host, path, verdict) are keyed by the 64-bit xxHash of ``host + path``. The sorted keys and
the rule strings are stored as flat files in the shared folder, copied once to every executor and
memory-mapped there. A URL's candidates are its host suffixes joined with its path prefixes, both of
lengths that occur together among the rules; all candidates of a batch are probed with one vectorised binary
search, and each hit is confirmed against the stored string, so a digest collision cannot match.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Workspace, add_columns, table

SEED = 42
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Size bound of one index file set; more rules go to further shards, each mapped on its own.
SHARD_BYTES = 256 << 20

_mapped: dict[str, tuple] = {}


def url_parts(url):
    """Columns (host, path): the host after the first ``://`` with A-Z lower-cased, then the path."""
    url = F.coalesce(url, F.lit(""))
    pattern = "://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER), F.regexp_extract(url, pattern, 2)


def build_index(spark: SparkSession, rules: DataFrame, shard_bytes: int = SHARD_BYTES) -> dict:
    """Write the digest shards of ``rules`` and register them with the executors.

    Only one shard's rules are on the driver at a time, and a shard's size is measured first. The pairs of
    lengths of host and path that occur are few, as URLs are short.
    Rules with a null host or path are ignored; of equal (host, path) rows 'block' wins.
    """
    rules = (
        rules.where("host IS NOT NULL AND path IS NOT NULL")
        .groupBy("host", "path")
        .agg(F.when(F.max(F.col("verdict") == "block"), "block").otherwise("allow").alias("verdict"))
        .withColumn("rule", F.concat("host", "path"))
        .withColumn("digest", F.xxhash64("rule"))
    )
    size = rules.agg(F.sum(F.octet_length("rule") + 40)).first()[0] or 0
    shards = 1 + int(size // shard_bytes)
    space, names = Workspace(spark, "url-rules"), []
    placed = rules.select("rule", "host", "path", "verdict", F.pmod("digest", F.lit(shards)).alias("shard"))
    placed.repartition(shards, "shard").write.partitionBy("shard").parquet(f"{space.root}/rules")
    rules = spark.read.schema(placed.schema).parquet(f"{space.root}/rules")
    lengths: dict[int, list[int]] = {}
    for host, path in sorted(map(tuple, rules.select(F.char_length("host"), F.char_length("path")).distinct().collect())):
        lengths.setdefault(host, []).append(path)
    for shard in range(shards):
        rows = rules.where(F.col("shard") == shard).select("rule", "host", "verdict").collect()
        digests = np.array([xxhash.xxh64_intdigest(r.rule, SEED) for r in rows], dtype=np.uint64)
        order = np.argsort(digests, kind="stable")
        texts = [f"{len(rows[i].host)}\t{rows[i].verdict}\t{rows[i].rule}".encode() for i in order]
        ends = np.cumsum([0, *map(len, texts)]).astype(np.int64)
        name = f"url-{uuid.uuid4().hex}"
        for part, data in (("keys", digests[order].tobytes()), ("ends", ends.tobytes()), ("text", b"".join(texts))):
            spark.sparkContext.addFile(space.put(f"{name}.{part}", data))
        names.append((name, len(rows)))
    return {"shards": names, "lengths": lengths}


def _shard(name: str, count: int) -> tuple:
    if name not in _mapped:
        keys, ends = (np.memmap(SparkFiles.get(f"{name}.{part}"), dtype=kind, mode="r") for part, kind in (("keys", np.uint64), ("ends", np.int64)))
        text = np.memmap(SparkFiles.get(f"{name}.text"), dtype=np.uint8, mode="r")
        _mapped[name] = keys, ends, text
    return _mapped[name]


def _candidates(host: str, path: str, lengths: dict[int, list[int]]) -> list[tuple[str, str]]:
    """The (host, path) that a fitting rule could have: suffixes and beginnings of lengths that occur among the rules."""
    found = []
    for h, paths in lengths.items():
        if 0 < h <= len(host) and (h == len(host) or host[-h - 1] == "."):
            found += [(host[len(host) - h :], path[:n]) for n in paths if n <= len(path)]
    return found


def _probe(hosts: list[str], paths: list[str], index: dict, default: str) -> tuple[list, list]:
    owners, texts = [], []
    for row, (host, path) in enumerate(zip(hosts, paths, strict=True)):
        for found in _candidates(host, path, index["lengths"]):
            owners.append(row)
            texts.append(found)
    digests = np.array([xxhash.xxh64_intdigest(h + p, SEED) for h, p in texts], dtype=np.uint64)
    best: dict[int, tuple[tuple[int, int], str, str]] = {}
    for keys, ends, text in (_shard(*s) for s in index["shards"] if s[1]):
        left, right = np.searchsorted(keys, digests, "left"), np.searchsorted(keys, digests, "right")
        for i in np.flatnonzero(left < right):
            row, (host, path) = owners[i], texts[i]
            for k in range(left[i], right[i]):
                size, verdict, rule = bytes(text[ends[k] : ends[k + 1]]).decode().split("\t", 2)
                if rule == host + path and int(size) == len(host) and (len(rule), len(host)) > best.get(row, ((0, 0),))[0]:
                    best[row] = (len(rule), len(host)), rule, verdict
    rows = range(len(hosts))
    return [best[i][1] if i in best else None for i in rows], [best[i][2] if i in best else default for i in rows]


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Verdict of every row's url: (all id columns), host, path, rule, verdict.

    A rule fits its host and all subdomains when the path starts with the rule's; the longest wins,
    of equally long ones that of the longer host.
    A url that is null or has no ``://`` gets an empty host and path, no rule and ``default``; so
    does one that no rule fits, since an absent key in a block list means the URL passes. Repeated
    rows are judged each on their own; an empty table gives an empty result.
    """
    index = build_index(pages.sparkSession, rules)
    host, path = url_parts(F.col(url))
    rows = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    kept = [c for c in rows.columns if c != url]
    make = lambda: lambda b: _probe(b.column("host").to_pylist(), b.column("path").to_pylist(), index, default)
    return add_columns(rows.select(*kept), kept, {"rule": pa.string(), "verdict": pa.string()}, make)


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)


OP8_SQL = f"""
WITH rules(host, path, verdict) AS (VALUES {", ".join(map(str, RULES))}),
parts AS (
  SELECT page_id, coalesce(url, '') AS u, row_number() OVER () AS n FROM pages),
split AS (
  SELECT page_id, n,
    translate(regexp_extract(u, '://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(u, '://([^/?#]*)([^?#]*)', 2) AS path
  FROM parts),
fit AS (
  SELECT s.n, max_by(r.host || r.path, (length(r.host || r.path), length(r.host))) AS rule,
         max_by(r.verdict, (length(r.host || r.path), length(r.host))) AS verdict
  FROM split s JOIN rules r
    ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path)
  GROUP BY s.n)
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM split s LEFT JOIN fit f USING (n)
"""
