"""Shuffled shards of a corpus by a two-pass external shuffle, in DataFrame operations only.

Pass one scatters whole records uniformly over memory-sized buckets with a seeded hash, one shuffle
partition for each bucket. Pass two takes each bucket into memory, runs Spark's Fisher-Yates
``shuffle`` over it and writes it. The written buckets, one after another, are one random permutation
of the corpus; cutting it into equal runs gives the shards. The permutation is read back from the
written table, so a task that is run again after a lost executor can't deal records differently. A
corpus of more buckets than one exchange should have is scattered over groups of buckets first, which
are written and then shuffled one after another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Workspace, table

BUCKET_BYTES, GROUP_BUCKETS = 16 << 20, 16_384
BROADCAST_BUCKETS = 1_000_000


def _shuffle_buckets(scattered: DataFrame, buckets: int, first: int, seed: int) -> DataFrame:
    """(__bucket, __pos, record columns) of records (__place from 0 to buckets - 1, __key, __row, __record).

    Each bucket is a partition of its own, sorted before it is collected, so the result doesn't
    depend on the order in which the shuffle's parts arrive.
    """
    dealt = scattered.repartitionById(buckets, F.col("__place")).sortWithinPartitions("__key", "__row")
    return (
        dealt.groupBy("__place")
        .agg(F.collect_list("__record").alias("__records"))
        .select((F.col("__place") + first).alias("__bucket"), F.posexplode(F.shuffle("__records", seed)).alias("__pos", "__record"))
        .select("__bucket", "__pos", "__record.*")
    )


def shuffle_into_shards(
    records: DataFrame, shards: int, text: str = "text", seed: int = 7, bucket_bytes: int = BUCKET_BYTES, group_buckets: int = GROUP_BUCKETS
) -> DataFrame:
    """All columns of ``records`` and shard (0 to shards - 1), slot (gapless from 0 in its shard).

    Law ``rows``: shard sizes differ by at most one record. Records with equal text or a null id are
    placed one by one like any others: the scatter hashes the record's number in the input, so
    repeated rows spread over all buckets. The same input files and seed give the same result; a
    frame that is not read from files should be written first, since its rows have no fixed numbers.
    An empty table gives an empty result; with fewer records than shards some shards stay empty.
    Columns named shard or slot are replaced.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    spark, space = records.sparkSession, Workspace(records.sparkSession, "shards")
    records = records.drop("shard", "slot")
    size = records.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 64)).first()[0] or 0
    buckets = max(shards, -(-size // bucket_bytes))
    names = records.columns
    numbered = records.select(F.monotonically_increasing_id().alias("__row"), F.struct(*names).alias("__record"))
    numbered = numbered.withColumn("__key", F.xxhash64(F.lit(seed), "__row"))
    bucket = F.pmod("__key", F.lit(buckets))
    if buckets <= group_buckets:
        shuffled = space.write(_shuffle_buckets(numbered.withColumn("__place", bucket.cast("int")), buckets, 0, seed), "buckets")
    else:
        grouped = numbered.withColumns({"__group": (bucket / group_buckets).cast("int"), "__place": (bucket % group_buckets).cast("int")})
        grouped.write.option("compression", "zstd").partitionBy("__group").parquet(f"{space.root}/scattered")
        for group in range(-(-buckets // group_buckets)):
            first = group * group_buckets
            part = spark.read.schema(grouped.schema).parquet(f"{space.root}/scattered").where(F.col("__group") == group)
            own = _shuffle_buckets(part.drop("__group"), min(group_buckets, buckets - first), first, seed)
            own.write.mode("append").option("compression", "zstd").parquet(f"{space.root}/buckets")
        shuffled = space.read("buckets", own)
    counts = shuffled.groupBy("__bucket").agg(F.count("*").alias("__n"))
    ahead = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    places = counts.select(
        "__bucket",
        F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__before"),
        F.sum("__n").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__all"),
    )
    if buckets <= BROADCAST_BUCKETS:  # one row of 24 bytes for each bucket
        places = F.broadcast(places)
    base, more = F.expr(f"__all div {shards}"), F.expr(f"__all % {shards}")
    rank = F.col("__before") + F.col("__pos")
    dealt = shuffled.join(places, "__bucket").withColumns({"__rank": rank, "__cut": more * (base + 1), "__base": base, "__more": more})
    shard = F.when(F.col("__rank") < F.col("__cut"), F.expr("__rank div (__base + 1)")).otherwise(
        F.col("__more") + F.expr("(__rank - __cut) div greatest(__base, 1)")
    )
    slot = F.when(F.col("__rank") < F.col("__cut"), F.expr("__rank % (__base + 1)")).otherwise(F.expr("(__rank - __cut) % greatest(__base, 1)"))
    return dealt.select(*names, shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def write_shards(records: DataFrame, path: str, shards: int, text: str = "text", seed: int = 7) -> None:
    """Write the shards as Parquet under ``path``/shard=N, each in slot order."""
    dealt = shuffle_into_shards(records, shards, text, seed)
    dealt.repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = shuffle_into_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), 16)
    body = F.coalesce(F.col("text"), F.lit(""))
    return dealt.select(
        "doc_id",
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
