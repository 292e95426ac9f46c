"""Panel alignment: grids, bounded fills, returns, currency conversion, complete cases.

Long tables (date, instrument, level or ret); a missing value is null. All windows are partitioned
by instrument (or date), so a panel spreads over its instruments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_GAP = 5


def canonical(name: Column) -> Column:
    """``ticker:SYMBOL`` with the prefix added or normalised and the symbol in capitals."""
    bare = F.regexp_replace(F.trim(name), "^(?i)ticker:", "")
    return F.concat(F.lit("ticker:"), F.upper(F.trim(bare)))


def canonical_ids(names: DataFrame, column: str = "name") -> DataFrame:
    """(instrument, n, problem) for each canonical id; several spellings are a duplicate, other domains foreign."""
    foreign = F.trim(column).rlike("^[A-Za-z]+:") & ~F.lower(F.trim(column)).startswith("ticker:")
    ids = names.select(F.when(foreign, F.trim(column)).otherwise(canonical(F.col(column))).alias("instrument"), foreign.alias("foreign"), F.col(column).alias("spelling"))
    counted = ids.groupBy("instrument").agg(F.count_distinct("spelling").alias("n"), F.max("foreign").alias("foreign"))
    return counted.select("instrument", "n", F.when(F.col("foreign"), "foreign").when(F.col("n") > 1, "duplicate").alias("problem"))


def trading_grid(levels: DataFrame) -> DataFrame:
    """(date, instrument, level) for every observed day and every instrument."""
    grid = levels.select("date").distinct().crossJoin(levels.select("instrument").distinct())
    return grid.join(levels, ["date", "instrument"], "left")


def bounded_fill(grid: DataFrame, max_gap: int = MAX_GAP) -> DataFrame:
    """(date, instrument, raw, level): the last level of at most ``max_gap`` rows before."""
    recent = Window.partitionBy("instrument").orderBy("date").rowsBetween(-max_gap, 0)
    return grid.select("date", "instrument", F.col("level").alias("raw"), F.last("level", ignorenulls=True).over(recent).alias("level"))


def live_edge(filled: DataFrame) -> DataFrame:
    """Rows after an instrument's last own observation are null again; adds last_seen."""
    own = Window.partitionBy("instrument")
    seen = filled.withColumn("last_seen", F.max(F.when(F.col("raw").isNotNull(), F.col("date"))).over(own))
    return seen.withColumn("level", F.when(F.col("date") <= F.col("last_seen"), F.col("level")))


def align(levels: DataFrame, max_gap: int = MAX_GAP) -> DataFrame:
    return live_edge(bounded_fill(trading_grid(levels), max_gap))


def alignment_counters(aligned: DataFrame) -> DataFrame:
    """One row: filled_cells and trailing_gap_cells."""
    return aligned.agg(
        F.count_if(F.col("raw").isNull() & F.col("level").isNotNull()).alias("filled_cells"),
        F.count_if(F.col("date") > F.col("last_seen")).alias("trailing_gap_cells"),
    )


def simple_returns(levels: DataFrame) -> DataFrame:
    """(date, instrument, ret): null where either side is."""
    before = F.lag("level").over(Window.partitionBy("instrument").orderBy("date"))
    return levels.select("date", "instrument", (F.try_divide("level", before) - 1).alias("ret"))


def realign_rates(days: DataFrame, rates: DataFrame, max_gap: int = MAX_GAP) -> DataFrame:
    """Rates on the days of a panel, under the same bounded fill and live edge."""
    grid = days.select("date").distinct().crossJoin(rates.select("currency").distinct()).join(rates, ["date", "currency"], "left")
    as_levels = grid.select("date", F.col("currency").alias("instrument"), F.col("usd_per_unit").alias("level"))
    done = live_edge(bounded_fill(as_levels, max_gap))
    return done.select("date", F.col("instrument").alias("currency"), F.col("level").alias("usd_per_unit"))


def convert_levels(levels: DataFrame, native: DataFrame, rates: DataFrame, target: str) -> DataFrame:
    """Levels in ``target``: level x native rate / target rate on the same day; the same currency is left alone."""
    own = rates.select("date", F.col("currency"), F.col("usd_per_unit").alias("own_rate"))
    other = rates.where(F.col("currency") == target).select("date", F.col("usd_per_unit").alias("target_rate"))
    joined = levels.join(native.select("instrument", "currency"), "instrument").join(own, ["date", "currency"], "left").join(other, "date", "left")
    converted = F.when(F.col("currency") == target, F.col("level")).otherwise(F.try_divide(F.col("level") * F.col("own_rate"), F.col("target_rate")))
    return joined.select("date", "instrument", converted.alias("level"))


def complete_case(returns: DataFrame) -> DataFrame:
    """Rows of the days on which every instrument of the panel has a return."""
    size = returns.select(F.count_distinct("instrument").alias("universe"))
    whole = returns.groupBy("date").agg(F.count("ret").alias("have")).crossJoin(F.broadcast(size)).where("have = universe").select("date")
    return returns.join(whole, "date", "left_semi")


def dataset_metadata(aligned: DataFrame) -> DataFrame:
    """One row: rows, instruments, filled and trailing cells, days with every return."""
    returns = simple_returns(aligned)
    days = complete_case(returns).agg(F.count_distinct("date").alias("complete_rows"))
    size = aligned.agg(F.count_distinct("date").alias("n_rows"), F.count_distinct("instrument").alias("instruments"))
    return size.crossJoin(alignment_counters(aligned)).crossJoin(days)


def check_dataset(metadata: DataFrame, expected: int) -> None:
    """Raise where a panel is too short or lacks an instrument."""
    row = metadata.first()
    if row["complete_rows"] < 3:
        raise ValueError(f"only {row['complete_rows']} complete rows")
    if row["instruments"] < expected:
        raise ValueError(f"{expected - row['instruments']} instruments are missing")


def required_universe(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """(instrument, role): the union of tables with a column instrument, each id in its first role."""
    rows = None
    for k, (role, frame) in enumerate(parts):
        one = frame.select("instrument").distinct().select("instrument", F.lit(k).alias("place"), F.lit(role).alias("role"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("instrument").agg(F.min_by("role", "place").alias("role"))
