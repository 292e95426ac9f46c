"""Adaptive pruning as a walk-forward run: evidence windows, a tree for every fold, and its targets.

Evidence before each signal comes from running sums and, for the worst fall within a window, which sums can't
give, from summaries of runs of days (highest and lowest wealth, worst fall) that are merged: each
arm has those of all runs of 1, 2, 4, .. days by their last day, and a window is at most one of
each length. Decisions, contraction and both passes are keyed by fold, so one loop over the
levels of the tree serves all folds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborfolio.functions.periods import years_after
from arborfolio.operators import hierarchy as hi
from arborfolio.operators import pruning as pru
from arborfolio.operators.ledger import _ratios


def common_dates(curves: DataFrame, sides: tuple[str, str] = ("NODE:", "FATHER:")) -> DataFrame:
    """(arm, date, ret) of the arms whose names start with one of two prefixes, on the dates that both arms of a name have."""
    prefix = F.when(F.col("arm").startswith(sides[0]), sides[0]).when(F.col("arm").startswith(sides[1]), sides[1])
    named = curves.withColumn("side", prefix).where("side IS NOT NULL").withColumn("name", F.expr("substr(arm, length(side) + 1)"))
    both = named.groupBy("name", "date").agg(F.count_distinct("side").alias("n")).where("n = 2").select("name", "date")
    return named.join(both, ["name", "date"], "left_semi").select("arm", "date", "ret")


def _runs(days: DataFrame, levels: int) -> DataFrame:
    """(arm, level, last, high, low, fall): the summary of the 2^level days of an arm up to its day number ``last``."""
    order = Window.partitionBy("arm").orderBy("i")
    found = days.select("arm", "i", F.struct(F.col("wealth").alias("high"), F.col("wealth").alias("low"), F.lit(1.0).alias("fall")).alias("run0"))
    for k in range(levels):
        early, late = F.lag(f"run{k}", 1 << k).over(order), F.col(f"run{k}")
        fall = F.least(early["fall"], late["fall"], late["low"] / early["high"])
        merged = F.struct(F.greatest(early["high"], late["high"]).alias("high"), F.least(early["low"], late["low"]).alias("low"), fall.alias("fall"))
        found = found.withColumn(f"run{k + 1}", F.when(early.isNotNull(), merged))
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.col(f"run{k}").alias("run")) for k in range(levels + 1)))).alias("r")
    return found.select("arm", F.col("i").alias("last"), rows).select("arm", "r.level", "last", "r.run.*").where("fall IS NOT NULL")


def window_metrics(curves: DataFrame, signals: DataFrame, years: float | None, inclusive: bool = False) -> DataFrame:
    """(arm, signal, the metrics at rate 0, n_obs, max_drawdown) on each arm's days before the signal, from ``years`` before it on.

    Without ``years`` the window has no start. With ``inclusive`` the signal's own day counts. Wealth and its
    peak start anew in each window. An arm without a day in a window has no row there.
    """
    so_far = Window.partitionBy("arm").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    short = F.least(F.col("ret"), F.lit(0.0))
    days = curves.select("arm", "date", "ret").select(
        "arm", "date", F.count("*").over(so_far).cast("int").alias("i"), F.product(1 + F.col("ret")).over(so_far).alias("wealth"),
        F.sum("ret").over(so_far).alias("s"), F.sum(F.col("ret") * F.col("ret")).over(so_far).alias("ss"), F.sum(short * short).over(so_far).alias("down"),
    )
    first = days.groupBy("arm").agg(F.min("date").alias("first"), F.max("i").alias("all"))
    asked = first.join(signals.select("signal").distinct(), F.col("first") <= F.col("signal"))  # the rows of the result
    start = years_after(F.col("signal"), -years) if years is not None else F.lit(None).cast("date")
    marks = asked.select("arm", "signal", F.explode(F.array(F.struct(F.lit("to").alias("end"), F.col("signal").alias("date")), F.struct(F.lit("from").alias("end"), start.alias("date")))).alias("m")).select("arm", "signal", "m.*")
    sums = F.struct("i", "wealth", "s", "ss", "down").alias("sums")
    turn = F.when((F.col("end") == "to") & F.lit(inclusive), 1).when(F.col("end").isNull(), 0).otherwise(-1)
    none = [F.lit(None).cast("date").alias("signal"), F.lit(None).cast("string").alias("end")]
    rows = days.select("arm", "date", sums, *none).unionByName(marks.where("date IS NOT NULL").withColumn("sums", F.lit(None).cast(days.select(sums).schema["sums"].dataType)))
    last = F.last("sums", True).over(Window.partitionBy("arm").orderBy("date", turn).rowsBetween(Window.unboundedPreceding, 0))
    ends = rows.withColumn("sums", last).where("signal IS NOT NULL").groupBy("arm", "signal").agg(*(F.max(F.when(F.col("end") == e, F.col("sums"))).alias(f"{e}_") for e in ("from", "to")))
    before = {c: F.coalesce(F.col(f"from_.{c}"), F.lit(v)) for c, v in (("i", 0), ("wealth", 1.0), ("s", 0.0), ("ss", 0.0), ("down", 0.0))}
    spans = ends.where("to_ IS NOT NULL").select("arm", "signal", before["i"].alias("a"), F.col("to_.i").alias("b"), *((F.col(f"to_.{c}") - before[c]).alias(c) for c in ("s", "ss", "down")), (F.col("to_.wealth") / before["wealth"]).alias("wealth")).where("b > a")
    levels = max(0, (first.agg(F.max("all")).first()[0] or 1).bit_length() - 1)
    bits = F.filter(F.sequence(F.lit(0), F.lit(levels)), lambda k: F.pmod(F.floor((F.col("b") - F.col("a")) / F.pow(F.lit(2.0), k)), F.lit(2)) == 1)
    parts = spans.select("arm", "signal", "a", "b", F.explode(bits).alias("level")).withColumn("last", F.expr("cast(b - (b - a) % power(2, level) as int)"))
    met = parts.join(_runs(days, levels), ["arm", "level", "last"]).groupBy("arm", "signal").agg(F.sort_array(F.collect_list(F.struct("last", "high", "low", "fall"))).alias("runs"))
    merged = F.aggregate(
        "runs", F.struct(F.lit(0.0).alias("high"), F.lit(1.0).alias("fall")),
        lambda t, r: F.struct(F.greatest(t["high"], r["high"]).alias("high"), F.least(t["fall"], r["fall"], F.when(t["high"] > 0, r["low"] / t["high"]).otherwise(1.0)).alias("fall")),
    )
    n = F.col("b") - F.col("a")
    base = spans.join(met.select("arm", "signal", (merged["fall"] - 1).alias("max_drawdown")), ["arm", "signal"]).select(
        "arm", "signal", n.cast("long").alias("n_obs"), "wealth", F.when(n > 1, F.sqrt(F.greatest((F.col("ss") - F.col("s") * F.col("s") / n) / (n - 1), F.lit(0.0)))).alias("sd"),
        (F.col("s") / n).alias("mean"), F.greatest(F.col("down") / n, F.lit(0.0)).alias("short"), "max_drawdown",
    )
    return _ratios(base, ["arm", "signal"], "max_drawdown")


def fold_decisions(curves: DataFrame, folds: DataFrame, nodes: DataFrame, years: float | None = None) -> DataFrame:
    """(fold_id, node_id, decision, reason) for each fold (fold_id, signal) and node that has a proxy, from the curves NODE:x and FATHER:x before the signal.

    A node without evidence is pruned, as in every protocol.
    """
    done = window_metrics(common_dates(curves), folds, years)
    side = F.when(F.col("arm").startswith("NODE:"), "NODE").otherwise("FATHER")
    name = F.expr("substr(arm, instr(arm, ':') + 1)")
    label = lambda f, n: F.concat(f.cast("string"), F.lit("/"), n)
    met = done.join(folds.select("fold_id", "signal"), "signal")
    measured = met.select(F.lit("accumulated").alias("protocol"), label(F.col("fold_id"), name).alias("node_id"), side.alias("side"), F.col("annualized_sharpe").alias("sharpe"), "max_drawdown", F.col("annualized_volatility").alias("volatility"))
    wanted = folds.select("fold_id").join(nodes.select(F.col("node_id").alias("name")).distinct())
    told = pru.decisions(pru.observations(wanted.select(label(F.col("fold_id"), F.col("name")).alias("node_id")), measured, ["accumulated"]))
    return wanted.withColumn("label", label(F.col("fold_id"), F.col("name"))).join(told.withColumnRenamed("node_id", "label"), "label").select("fold_id", F.col("name").alias("node_id"), "decision", "reason")


def fold_trees(slots: DataFrame, decided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The actions (fold_id, node_id, action, new_parent) and slots of every fold's contracted tree."""
    folds = decided.select("fold_id").distinct()
    edges = slots.where("child_id IS NOT NULL").select(F.col("child_id").alias("node_id"), F.col("node_id").alias("parent_id")).distinct()
    roots = slots.select("node_id").distinct().join(edges, "node_id", "left_anti")
    nodes = edges.unionByName(roots.withColumn("parent_id", F.lit(None).cast(slots.schema["node_id"].dataType)))
    actions = pru.contraction(folds.join(nodes), decided, ["fold_id"])
    return actions, pru.contracted_slots(slots, actions, folds.join(roots), ["fold_id"])


def adaptive_run(slots: DataFrame, depths: DataFrame, returns: DataFrame, folds: DataFrame, static: DataFrame, decided: DataFrame, burn_in: float, allocate: hi.Allocator = hi.by_mean_return) -> DataFrame:
    """(fold_id, arm, instrument, weight, burn_in): the arms FINAL and FORWARD_FINAL of the adaptive walk-forward.

    Folds (fold_id, signal, holding_start) whose signal is before the first holding start plus
    ``burn_in`` years keep the ``static`` targets (fold_id, arm, instrument, weight); the others are allocated
    again, backward and forward, on the tree that their decisions leave.
    """
    first = folds.agg(years_after(F.min("holding_start"), burn_in).alias("cutoff"))
    late = folds.join(first).where("signal >= cutoff").select("fold_id")
    _, own = fold_trees(slots, decided.join(late, "fold_id", "left_semi"))
    kept = returns.join(late, "fold_id", "left_semi")
    forward = hi.forward_pass(own, kept, allocate)
    backward = hi.backward_pass(own, depths, kept, allocate, forward)
    roots = slots.select("node_id").distinct().join(slots.select(F.col("child_id").alias("node_id")), "node_id", "left_anti")
    arm = lambda w, name: hi.terminal_weights(w, roots).select("fold_id", F.lit(name).alias("arm"), "instrument", "weight", F.lit(False).alias("burn_in"))
    early = static.where("arm IN ('FINAL', 'FORWARD_FINAL')").join(late, "fold_id", "left_anti").select("fold_id", "arm", "instrument", "weight", F.lit(True).alias("burn_in"))
    return arm(backward, "FINAL").unionByName(arm(forward, "FORWARD_FINAL")).unionByName(early)
