"""Resampling, rebalance schedules and walk-forward folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborfolio.functions.periods import period_is_complete, period_label


def resample(returns: DataFrame, frequency: str) -> DataFrame:
    """(date, instrument, ret): compounded by period label; periods that lack an instrument are dropped."""
    kept = returns.where("ret IS NOT NULL")
    compounded = kept.groupBy(period_label(F.col("date"), frequency).alias("date"), "instrument").agg((F.product(1 + F.col("ret")) - 1).alias("ret"))
    size = returns.select(F.count_distinct("instrument").alias("universe"))
    whole = compounded.groupBy("date").agg(F.count("*").alias("have")).crossJoin(F.broadcast(size)).where("have = universe").select("date")
    return compounded.join(whole, "date", "left_semi")


def final_period(days: DataFrame, frequency: str) -> DataFrame:
    """One row: last_day, label and whether the final period is complete."""
    last = days.agg(F.max("date").alias("last_day"))
    return last.select("last_day", period_label(F.col("last_day"), frequency).alias("label"), period_is_complete(F.col("last_day"), frequency).alias("complete"))


def rebalance_schedule(days: DataFrame, frequency: str, partial_last: bool = False) -> DataFrame:
    """(signal): period labels, without the last if its period is incomplete."""
    labels = days.select(period_label(F.col("date"), frequency).alias("signal")).distinct()
    if partial_last:
        return labels
    end = final_period(days, frequency)
    return labels.join(F.broadcast(end.where("NOT complete").select(F.col("label").alias("signal"))), "signal", "left_anti")


def estimation_ordinals(estimation: DataFrame) -> DataFrame:
    """(date, e): the estimation periods in order, from 1."""
    return estimation.select("date").distinct().withColumn("e", F.row_number().over(Window.orderBy("date")))


def folds(valuation: DataFrame, estimation: DataFrame, schedule: DataFrame, train_size: int, expanding: bool = False, partial_last: bool = False) -> DataFrame:
    """(fold_id, signal, next_signal, first_e, last_e, training_start, training_end, holding_start, holding_end).

    Training: the last ``train_size`` estimation periods labelled up to the signal (all, if
    expanding); holding: valuation days after the signal up to the next. Folds without enough
    training or without a holding day are left out, as is the last signal unless partial periods count.
    The schedule is one row a period, so ordering it in one task is no bottleneck.
    """
    order = Window.orderBy("signal")
    signals = schedule.withColumn("next_signal", F.lead("signal").over(order))
    if not partial_last:
        signals = signals.where("next_signal IS NOT NULL")
    ordinals = estimation_ordinals(estimation)
    marks = ordinals.select(F.col("date").alias("day"), "e", F.lit(None).cast("date").alias("signal")).unionByName(
        signals.select(F.col("signal").alias("day"), F.lit(None).cast("int").alias("e"), "signal")
    )
    so_far = Window.orderBy("day", F.col("e").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    reached = marks.withColumn("last_e", F.max("e").over(so_far)).where("signal IS NOT NULL").select("signal", "last_e")
    known = signals.join(reached, "signal").where(F.col("last_e") >= train_size)
    known = known.withColumn("first_e", F.lit(1) if expanding else F.col("last_e") - train_size + 1)
    edge = ordinals.withColumnsRenamed({"date": "edge", "e": "edge_e"})
    known = known.join(edge, known["first_e"] == edge["edge_e"]).withColumnRenamed("edge", "training_start").drop("edge_e")
    known = known.join(edge, known["last_e"] == edge["edge_e"]).withColumnRenamed("edge", "training_end").drop("edge_e")
    held = holding_days(valuation, signals).groupBy("signal").agg(F.min("date").alias("holding_start"), F.max("date").alias("holding_end"))
    return known.join(held, "signal").withColumn("fold_id", F.row_number().over(order))


def holding_days(valuation: DataFrame, signals: DataFrame) -> DataFrame:
    """(signal, date): each valuation day with the last signal before it, while that signal holds."""
    marks = valuation.select("date").distinct().select("date", F.lit(None).cast("date").alias("at"), F.lit(None).cast("date").alias("until")).unionByName(
        signals.select(F.col("signal").alias("date"), F.col("signal").alias("at"), F.col("next_signal").alias("until"))
    )
    before = Window.orderBy("date", F.col("at").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("at").isNotNull(), F.struct("at", "until")), True).over(before)
    seen = marks.select("date", "at", last.alias("s")).select("date", "at", F.col("s.at").alias("signal"), F.col("s.until").alias("stop"))
    return seen.where("at IS NULL AND signal IS NOT NULL AND (stop IS NULL OR date <= stop)").select("signal", "date")


def training_rows(fold_table: DataFrame, estimation: DataFrame) -> DataFrame:
    """(fold_id, date, instrument, ret): an equi-join on period ordinals, no range join."""
    spread = fold_table.select("fold_id", F.explode(F.sequence("first_e", "last_e")).alias("e"))
    return spread.join(estimation_ordinals(estimation), "e").join(estimation, "date").select("fold_id", "date", "instrument", "ret")


def holding_rows(fold_table: DataFrame, valuation: DataFrame) -> DataFrame:
    """(fold_id, date, instrument, ret) of the holding days."""
    days = holding_days(valuation, fold_table.select("signal", "next_signal")).join(fold_table.select("fold_id", "signal"), "signal")
    return days.select("fold_id", "date").join(valuation, "date").select("fold_id", "date", "instrument", "ret")


def latest_window(estimation: DataFrame, train_size: int) -> DataFrame:
    """The rows of the last ``train_size`` estimation periods."""
    recent = estimation.select("date").distinct().orderBy(F.desc("date")).limit(train_size)
    return estimation.join(recent, "date", "left_semi")
