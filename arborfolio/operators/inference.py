"""Paired block-bootstrap tests and multiple-testing adjustment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLES, BLOCK, SEED = 2000, 20, 7
#: Paired observations, of some 40 bytes, that may be sent to every executor.
BROADCAST_ROWS = 200_000


def block_starts(keys: DataFrame, samples: int, seed: int = SEED) -> DataFrame:
    """(key.., n, sample, block, start): circular block starts from a hash that other engines share.

    ``keys`` has the number of observations n and of blocks per key. The starts are spread over the
    cluster by sample.
    """
    drawn = keys.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    text = F.concat_ws("|", F.lit(str(seed)), F.col("sample").cast("string"), F.col("block").cast("string"))
    return drawn.withColumn("start", F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % F.col("n"))


def resampled_indices(keys: DataFrame, samples: int, block: int, seed: int = SEED) -> DataFrame:
    """(key.., sample, k): indices modulo n, blocks of consecutive ones, cut to n."""
    starts = block_starts(keys, samples, seed)
    spread = starts.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(block - 1)))).where(F.col("block") * block + F.col("o") < F.col("n"))
    return spread.withColumn("k", (F.col("start") + F.col("o")) % F.col("n"))


def bootstrap(paired: DataFrame, key: list[str], samples: int = SAMPLES, block: int = BLOCK, periods: int = 252) -> DataFrame:
    """Per key: n, mean difference a year, its 95 % interval and null-centred p; and the same for the Sharpe gap.

    ``paired`` has date, c, b, diff. With n <= block only the differences are given. The 4-byte sums of
    a sample are taken from the indexed rows by an equi-join; nothing is collected.
    """
    rows = paired.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy("date")) - 1)
    sharpe = (F.try_divide(F.avg("c"), F.stddev_samp("c")) - F.try_divide(F.avg("b"), F.stddev_samp("b"))) * F.sqrt(F.lit(float(periods)))
    point = rows.groupBy(key).agg(F.count("*").alias("n"), (F.avg("diff") * periods).alias("mean_diff"), sharpe.alias("sharpe_diff"))
    sized = point.where(F.col("n") > block).select(*key, "n", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    # The drawn indices are many times the rows, which the optimizer can't tell from the plan.
    rows_side = F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows.hint("shuffle_hash")
    picked = resampled_indices(sized, samples, block).join(rows_side, [*key, "k"])
    draws = picked.groupBy(*key, "sample").agg((F.avg("diff") * periods).alias("m"), sharpe.alias("s"))
    both = draws.join(point.select(*key, "mean_diff"), key)
    extreme = F.count_if(F.abs(F.col("m") - F.col("mean_diff")) >= F.abs(F.col("mean_diff")))
    found = both.groupBy(key).agg(
        F.percentile("m", F.lit(0.025)).alias("mean_lo"),
        F.percentile("m", F.lit(0.975)).alias("mean_hi"),
        ((1 + extreme) / (samples + 1)).alias("mean_p"),
        F.percentile("s", F.lit(0.025)).alias("sharpe_lo"),
        F.percentile("s", F.lit(0.975)).alias("sharpe_hi"),
        F.least(F.lit(1.0), 2 * F.least(F.avg((F.col("s") <= 0).cast("double")), F.avg((F.col("s") >= 0).cast("double")))).alias("sharpe_p"),
    )
    note = F.when(F.col("n") <= block, F.lit("too few observations"))
    return point.join(found, key, "left").withColumn("note", note)


def holm(tests: DataFrame, p: str = "p") -> DataFrame:
    """Adds adjusted: Holm's step-down p-values over all rows; null p stay out. One row a comparison."""
    known = tests.where(F.col(p).isNotNull())
    order = Window.orderBy(p, *[c for c in tests.columns if c != p])
    step = known.withColumn("rank", F.row_number().over(order)).withColumn("m", F.count("*").over(Window.partitionBy()))
    raw = F.least(F.lit(1.0), (F.col("m") - F.col("rank") + 1) * F.col(p))
    done = step.withColumn("adjusted", F.max(raw).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("rank", "m")
    return done.unionByName(tests.where(F.col(p).isNull()).withColumn("adjusted", F.lit(None).cast("double")))
