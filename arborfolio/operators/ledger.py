"""The drift ledger in closed form, turnover and costs, and performance metrics.

Within a fold that starts with weights w_i, growth G_i(t) is the product of 1 + r since its start,
and V(t) = 1 + sum w_i (G_i(t) - 1). The return of a day is V(t) / V(t-1) - 1 and the drifted weight
w_i G_i(t) / V(t). Folds start from their own targets, so they are independent; only turnover looks
back one fold, by a join.

Tables: targets (fold_id, arm, instrument, weight), holding rows (fold_id, date, instrument, ret),
curves (arm, fold_id, date, ret).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborfolio.functions.periods import period_label

DAYS = 252


def growth(targets: DataFrame, holding: DataFrame) -> DataFrame:
    """(fold_id, arm, date, instrument, weight, g): each position's growth so far."""
    so_far = Window.partitionBy("fold_id", "arm", "instrument").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    held = targets.join(holding, ["fold_id", "instrument"])
    return held.select("fold_id", "arm", "date", "instrument", "weight", F.product(1 + F.coalesce("ret", F.lit(0.0))).over(so_far).alias("g"))


def ledger_returns(grown: DataFrame) -> DataFrame:
    """(arm, fold_id, date, ret); null after a day on which nothing is left."""
    value = grown.groupBy("arm", "fold_id", "date").agg((1 + F.sum(F.col("weight") * (F.col("g") - 1))).alias("v"))
    before = F.coalesce(F.lag("v").over(Window.partitionBy("arm", "fold_id").orderBy("date")), F.lit(1.0))
    return value.select("arm", "fold_id", "date", F.when(before != 0, F.col("v") / before - 1).alias("ret"))


def recurrence_returns(targets: DataFrame, holding: DataFrame) -> DataFrame:
    """(arm, fold_id, date, ret) by the daily recurrence itself, as a second way to what ``ledger_returns`` has in closed form.

    Each fold of an arm folds its days in order: a day's return is the weighted sum of its instruments'
    returns, after which every weight grows by its own and is divided by the whole. The days of one fold
    are held together.
    """
    held = targets.join(holding, ["fold_id", "instrument"])
    days = held.groupBy("arm", "fold_id", "date").agg(F.sort_array(F.collect_list(F.struct("instrument", F.coalesce("ret", F.lit(0.0)).alias("ret"), "weight"))).alias("legs"))
    folds = days.groupBy("arm", "fold_id").agg(F.sort_array(F.collect_list(F.struct("date", "legs"))).alias("days"))
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda t, x: t + x)
    start = F.struct(F.transform(F.col("days")[0]["legs"], lambda x: x["weight"]).alias("w"), F.array().cast("array<struct<date:date,ret:double>>").alias("out"))

    def step(state, day):
        ret = add(F.zip_with(state["w"], day["legs"], lambda w, x: w * x["ret"]))
        moved = F.zip_with(state["w"], day["legs"], lambda w, x: w * (1 + x["ret"]) / (1 + ret))
        return F.struct(moved.alias("w"), F.array_append(state["out"], F.struct(day["date"].alias("date"), ret.alias("ret"))).alias("out"))

    walked = folds.select("arm", "fold_id", F.aggregate("days", start, step, lambda s: s["out"]).alias("out"))
    return walked.select("arm", "fold_id", F.inline("out"))


def reconciled(curves: DataFrame, targets: DataFrame, holding: DataFrame, tolerance: float = 5e-5) -> DataFrame:
    """(arm, fold_id, problem): folds whose curve has other dates than the recurrence, or is off by more than the tolerance on a day."""
    again = recurrence_returns(targets, holding).withColumnRenamed("ret", "again")
    both = curves.select("arm", "fold_id", "date", "ret").join(again, ["arm", "fold_id", "date"], "full")
    problem = F.when(F.col("ret").isNull() | F.col("again").isNull(), "dates differ").when(F.abs(F.col("ret") - F.col("again")) > tolerance, "returns differ")
    return both.withColumn("problem", problem).where("problem IS NOT NULL").select("arm", "fold_id", "problem").distinct()


def drifted_weights(grown: DataFrame) -> DataFrame:
    """(arm, fold_id, date, instrument, weight) at the end of each day."""
    value = 1 + F.sum(F.col("weight") * (F.col("g") - 1)).over(Window.partitionBy("arm", "fold_id", "date"))
    return grown.select("arm", "fold_id", "date", "instrument", F.try_divide(F.col("weight") * F.col("g"), value).alias("weight"))


def turnover_costs(targets: DataFrame, drifted: DataFrame, bps: float) -> DataFrame:
    """(arm, fold_id, turnover, cost): two-way, against the drifted weights of the fold before; the first from nothing."""
    last = drifted.groupBy("arm", "fold_id", "instrument").agg(F.max_by("weight", "date").alias("held"))
    held = last.select("arm", (F.col("fold_id") + 1).alias("fold_id"), "instrument", "held").join(targets.select("arm", "fold_id").distinct(), ["arm", "fold_id"], "left_semi")
    both = targets.join(held, ["arm", "fold_id", "instrument"], "full")
    moved = F.sum(F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("held", F.lit(0.0))))
    return both.groupBy("arm", "fold_id").agg(moved.alias("turnover")).withColumn("cost", F.col("turnover") * bps / 10_000)


def net_returns(returns: DataFrame, costs: DataFrame) -> DataFrame:
    """Returns with each fold's cost taken off its first day; weights are not reduced."""
    first = F.row_number().over(Window.partitionBy("arm", "fold_id").orderBy("date")) == 1
    joined = returns.join(costs.select("arm", "fold_id", "cost"), ["arm", "fold_id"])
    return joined.select("arm", "fold_id", "date", F.when(first, F.col("ret") - F.col("cost")).otherwise(F.col("ret")).alias("ret"))


def financing_returns(days: DataFrame, nodes: DataFrame) -> DataFrame:
    """(date, instrument, ret): accruals of lending and borrowing cash of the nodes (node_id, is_root, risk_free, spread_bps, financing)."""
    cash = nodes.where("financing").select(
        F.explode(
            F.array(
                F.struct(F.lit("cash:RF").alias("leg"), (F.col("risk_free") / DAYS).alias("ret")),
                F.struct(F.lit("cash:BORROW").alias("leg"), ((F.col("risk_free") + F.col("spread_bps") / 10_000) / DAYS).alias("ret")),
            )
        ).alias("c"),
        F.when(F.col("is_root"), "").otherwise(F.concat(F.lit("@"), "node_id")).alias("suffix"),
    )
    legs = cash.select(F.concat("c.leg", "suffix").alias("instrument"), "c.ret")
    return days.select("date").distinct().crossJoin(F.broadcast(legs))


def _sums(excess: Column) -> dict[str, Column]:
    """What the metrics need, as aggregates that also run over a window."""
    short = F.least(excess, F.lit(0.0))
    return {"n_obs": F.count("ret"), "wealth": F.product(1 + F.col("ret")), "sd": F.stddev_samp("ret"), "mean": F.avg(excess), "short": F.avg(short * short)}


def _ratios(base: DataFrame, key: list[str], *more: str) -> DataFrame:
    """The metrics of each key from its ``_sums``."""
    year, sd, down = F.lit(float(DAYS)), F.coalesce("sd", F.lit(0.0)), F.sqrt("short")
    return base.select(
        *key,
        (F.pow("wealth", F.try_divide(year, F.col("n_obs"))) - 1).alias("cagr"),
        (sd * F.sqrt(year)).alias("annualized_volatility"),
        (F.col("mean") * year).alias("annualized_excess_return"),
        F.when(sd > 0, F.col("mean") / sd * F.sqrt(year)).otherwise(0.0).alias("annualized_sharpe"),
        F.when(down > 0, F.col("mean") * year / (down * F.sqrt(year))).otherwise(0.0).alias("annualized_sortino"),
        "n_obs",
        *more,
    )


def metrics(curves: DataFrame, key: list[str], rate: Column | float = 0.0) -> DataFrame:
    """Per key: cagr, annualized volatility, excess, Sharpe, Sortino, n_obs; ``rate`` is a year's risk-free rate."""
    return _ratios(curves.groupBy(key).agg(*(c.alias(n) for n, c in _sums(F.col("ret") - rate / DAYS).items())), key)


def drawdowns(curves: DataFrame, key: list[str], *more: str) -> DataFrame:
    """Per key and date: wealth, its peak so far (from the first wealth value, not one), the drawdown and the columns ``more``."""
    so_far = Window.partitionBy(key).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    wealth = curves.withColumn("wealth", F.product(1 + F.col("ret")).over(so_far))
    peaked = wealth.withColumn("peak", F.max("wealth").over(so_far))
    return peaked.select(*key, "date", "wealth", "peak", (F.try_divide("wealth", "peak") - 1).alias("drawdown"), *more)


def max_drawdown(curves: DataFrame, key: list[str]) -> DataFrame:
    return drawdowns(curves, key).groupBy(key).agg(F.min("drawdown").alias("max_drawdown"))


def metrics_before(curves: DataFrame, signals: DataFrame, inclusive: bool = False) -> DataFrame:
    """Metrics (rate 0) per arm and signal on the dates strictly before it (or up to it), with max_drawdown.

    Each day gets the sums of its arm so far, in one window; a signal takes those of the last day
    within its reach. An arm without such a day has no row.
    """
    so_far = Window.partitionBy("arm").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    running = drawdowns(curves.select("arm", "date", "ret"), ["arm"], "ret").select(
        "arm", "date", F.struct(*(c.over(so_far).alias(n) for n, c in _sums(F.col("ret")).items()), F.min("drawdown").over(so_far).alias("max_drawdown")).alias("sums")
    )
    asked = curves.groupBy("arm").agg(F.min("date").alias("first")).join(signals.select("signal").distinct(), F.col("first") <= F.col("signal"))  # the rows of the result
    marks = asked.select("arm", F.col("signal").alias("date"), F.lit(None).cast(running.schema["sums"].dataType).alias("sums"), "signal")
    turn = F.when(F.col("signal").isNotNull(), F.lit(1 if inclusive else -1)).otherwise(0)
    up_to = Window.partitionBy("arm").orderBy("date", turn).rowsBetween(Window.unboundedPreceding, 0)
    last = running.withColumn("signal", F.lit(None).cast("date")).unionByName(marks).withColumn("sums", F.last("sums", True).over(up_to))
    return _ratios(last.where("signal IS NOT NULL AND sums IS NOT NULL").select("arm", "signal", "sums.*"), ["arm", "signal"], "max_drawdown")


def grid_gaps(curves: DataFrame) -> DataFrame:
    """(date, arms): dates on which some arm has no return."""
    size = curves.agg(F.count_distinct("arm").alias("all_arms"))
    by_day = curves.groupBy("date").agg(F.count_distinct("arm").alias("arms")).crossJoin(F.broadcast(size))
    return by_day.where("arms < all_arms").select("date", "arms")


def audit_series(returns: DataFrame, benchmark: DataFrame, children: DataFrame, forward: DataFrame, backward: DataFrame, implemented: DataFrame) -> DataFrame:
    """(fold_id, date, series, ret): every series that the estimates of a fold rest on or give, by name.

    RAW:x the training rows, REFERENCE:B0_RAW the benchmark, REFERENCE:FATHER:n a child's proxy, FORWARD_OUTPUT:n and
    RESULT_OUTPUT:n what a node earns by its weights of either pass, BACKWARD_INPUT:proxy_SYNTH what stands for a child
    in its parent, DIAGNOSTIC:B0_SYNTH the implemented benchmark. ``returns`` (fold_id, instrument, date, ret),
    ``benchmark`` (instrument, weight), ``children`` (node_id, proxy), ``forward`` (fold_id, node_id, instrument, weight)
    a node's own weights, ``backward`` the same down to instruments, ``implemented`` (fold_id, instrument, weight).
    """
    returns = returns.select("fold_id", "instrument", "date", "ret")

    def portfolio(weights: DataFrame, name: Column) -> DataFrame:
        on = [c for c in ("fold_id", "instrument") if c in weights.columns]
        return returns.join(weights.withColumn("series", name), on).groupBy("fold_id", "date", "series").agg(F.sum(F.col("weight") * F.col("ret")).alias("ret"))

    out = returns.select("fold_id", "date", F.concat(F.lit("RAW:"), "instrument").alias("series"), "ret")
    father = children.select("node_id", F.col("proxy").alias("instrument"), F.lit(1.0).alias("weight"))
    result = portfolio(backward, F.concat(F.lit("RESULT_OUTPUT:"), "node_id"))
    below = children.select(F.concat(F.lit("RESULT_OUTPUT:"), "node_id").alias("series"), F.concat(F.lit("BACKWARD_INPUT:"), "proxy", F.lit("_SYNTH")).alias("input"))
    for part in (
        portfolio(benchmark, F.lit("REFERENCE:B0_RAW")),
        portfolio(father, F.concat(F.lit("REFERENCE:FATHER:"), "node_id")),
        portfolio(forward, F.concat(F.lit("FORWARD_OUTPUT:"), "node_id")),
        result,
        result.join(below, "series").select("fold_id", "date", F.col("input").alias("series"), "ret"),
        portfolio(implemented, F.lit("DIAGNOSTIC:B0_SYNTH")),
    ):
        out = out.unionByName(part)
    return out


def compress(curves: DataFrame, points: int = 600) -> DataFrame:
    """(arm, date, ret): blocks of ceil(n / points) days compounded, dated at their end."""
    order = Window.partitionBy("arm").orderBy("date")
    placed = curves.withColumn("k", F.row_number().over(order) - 1).withColumn("step", F.ceil(F.count("*").over(Window.partitionBy("arm")) / points))
    blocks = placed.groupBy("arm", F.expr("k div step").alias("block"))
    return blocks.agg(F.max("date").alias("date"), (F.product(1 + F.col("ret")) - 1).alias("ret")).drop("block")


def weight_history(targets: DataFrame) -> DataFrame:
    """(arm, fold_id, instrument, weight) for every fold and component ever held, zero where absent."""
    ever = targets.groupBy("arm", "instrument").agg(F.max(F.abs("weight")).alias("most")).where("most > 0").select("arm", "instrument")
    grid = targets.select("arm", "fold_id").distinct().join(ever, "arm")
    return grid.join(targets, ["arm", "fold_id", "instrument"], "left").select("arm", "fold_id", "instrument", F.coalesce("weight", F.lit(0.0)).alias("weight"))


def paired_difference(curves: DataFrame, candidate: str, baseline: str) -> DataFrame:
    """(date, diff) on the dates both arms have."""
    one = lambda arm, name: curves.where(F.col("arm") == arm).select("date", F.col("ret").alias(name))
    return one(candidate, "c").join(one(baseline, "b"), "date").select("date", "c", "b", (F.col("c") - F.col("b")).alias("diff"))


def resample_curves(curves: DataFrame, frequency: str) -> DataFrame:
    return curves.groupBy("arm", period_label(F.col("date"), frequency).alias("date")).agg((F.product(1 + F.col("ret")) - 1).alias("ret"))
