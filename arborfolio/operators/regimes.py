"""Regime probabilities attached to panels: conditional means, transitions, blends, event rebalances.

A regime table is (date, state, p): the day's state and the probability of 'stress'.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborfolio.operators.hierarchy import Allocator


def by_state(regimes: DataFrame) -> DataFrame:
    """(date, state, weight): each day's probability of either state."""
    both = F.array(F.struct(F.lit("stress").alias("state"), F.col("p").alias("weight")), F.struct(F.lit("calm").alias("state"), (1 - F.col("p")).alias("weight")))
    return regimes.select("date", F.inline(both))


def conditional_means(returns: DataFrame, regimes: DataFrame) -> DataFrame:
    """(state, instrument, mu): probability-weighted means."""
    joined = returns.where("ret IS NOT NULL").join(by_state(regimes), "date")
    return joined.groupBy("state", "instrument").agg(F.try_divide(F.sum(F.col("weight") * F.col("ret")), F.sum("weight")).alias("mu"))


def transitions(regimes: DataFrame) -> DataFrame:
    """(date, state) of the days whose state differs from the day before; the first day counts.

    A regime table has one row a day, so its order in one task is no bottleneck.
    """
    before = F.lag("state").over(Window.orderBy("date"))
    return regimes.withColumn("before", before).where("before IS NULL OR before <> state").select("date", "state")


def as_of(days: DataFrame, regimes: DataFrame) -> DataFrame:
    """(date, state, p): the latest regime at or before each day, by one window over the union."""
    marks = days.select("date").distinct().select("date", F.lit(None).cast("string").alias("state"), F.lit(None).cast("double").alias("p"), F.lit(1).alias("asked"))
    marks = marks.unionByName(regimes.select("date", "state", "p", F.lit(0).alias("asked")))
    so_far = Window.orderBy("date", "asked").rowsBetween(Window.unboundedPreceding, 0)
    filled = marks.select("date", "asked", F.last("state", True).over(so_far).alias("state"), F.last("p", True).over(so_far).alias("p"))
    return filled.where("asked = 1").drop("asked")


def views(means: DataFrame, attached: DataFrame, periods: int) -> DataFrame:
    """(date, instrument, q): annual expected returns blended by the probabilities of the day."""
    return by_state(attached).join(means, "state").groupBy("date", "instrument").agg((periods * F.sum(F.col("weight") * F.col("mu"))).alias("q"))


def blended_best(training: DataFrame, states: DataFrame, signals: DataFrame, least: int = 3) -> DataFrame:
    """(fold_id, instrument, weight): each state's best instrument, from its own training rows, by probability.

    States with fewer than ``least`` rows leave their share to the other.
    """
    rows = training.join(states.select("date", "state"), "date")
    mean = rows.groupBy("fold_id", "state", "instrument").agg(F.avg("ret").alias("mu"), F.count("*").alias("n")).where(F.col("n") >= least)
    best = mean.withColumn("k", F.row_number().over(Window.partitionBy("fold_id", "state").orderBy(F.desc("mu"), "instrument"))).where("k = 1")
    share = best.join(signals.select("fold_id", "p"), "fold_id").withColumn("share", F.when(F.col("state") == "stress", F.col("p")).otherwise(1 - F.col("p")))
    total = Window.partitionBy("fold_id")
    scaled = share.withColumn("weight", F.when(F.sum("share").over(total) > 0, F.col("share") / F.sum("share").over(total)).otherwise(1 / F.count("*").over(total)))
    return scaled.groupBy("fold_id", "instrument").agg(F.sum("weight").alias("weight"))


def blended(training: DataFrame, states: DataFrame, signals: DataFrame, bounds: DataFrame, allocate: Allocator, least: int = 3) -> DataFrame:
    """(fold_id, instrument, weight): each state's own allocation, by the state's probability at the signal.

    A state stands as a node of the allocator, with the training rows of its own days; all states of all folds are one job.
    ``states`` (date, state), ``signals`` (fold_id, p), ``bounds`` (instrument, lo, hi). A state of fewer than ``least`` days
    leaves its share to the other; if that has no probability, it still takes the whole.
    """
    rows = training.where("ret IS NOT NULL").join(states.select("date", F.col("state").alias("node_id")), "date")
    enough = rows.groupBy("fold_id", "node_id").agg(F.count_distinct("date").alias("days")).where(F.col("days") >= least).select("fold_id", "node_id")
    series = rows.join(enough, ["fold_id", "node_id"], "left_semi").select("fold_id", "node_id", "instrument", "date", "ret")
    both = bounds.select(F.explode(F.array(F.lit("stress"), F.lit("calm"))).alias("node_id"), "instrument", "lo", "hi")
    p = F.when(F.col("node_id") == "stress", F.col("p")).otherwise(1 - F.col("p"))
    share = enough.join(signals.select("fold_id", "p"), "fold_id").withColumn("share", p)
    of = Window.partitionBy("fold_id")
    share = share.select("fold_id", "node_id", F.when(F.sum("share").over(of) > 0, F.col("share") / F.sum("share").over(of)).otherwise(1 / F.count("*").over(of)).alias("share"))
    return allocate(series, both).join(share, ["fold_id", "node_id"]).groupBy("fold_id", "instrument").agg(F.sum(F.col("share") * F.col("weight")).alias("weight"))


def lagged_switch(returns: DataFrame, regimes: DataFrame, stress: str, calm: str) -> DataFrame:
    """(date, ret): yesterday's state picks one of two instruments; no state yet gives null."""
    wide = returns.where(F.col("instrument").isin(stress, calm)).groupBy("date").agg(
        F.max(F.when(F.col("instrument") == stress, F.col("ret"))).alias("s"), F.max(F.when(F.col("instrument") == calm, F.col("ret"))).alias("c")
    )
    known = wide.join(regimes.select("date", "state"), "date").withColumn("before", F.lag("state").over(Window.orderBy("date")))
    return known.select("date", F.when(F.col("before") == "stress", F.col("s")).when(F.col("before") == "calm", F.col("c")).alias("ret"))
