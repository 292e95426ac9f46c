"""Queries on efficient frontiers, exact volatility, tracking-error caps, solved financing and trees of other objectives."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborfolio.functions.periods import rounded
from arborfolio.operators import frontier as fr
from arborfolio.operators import hierarchy as hi
from arborfolio.operators import ledger as le
from arborfolio.operators.moments import single_view_mean
from arborfolio.plans.allocation_queries import bounds
from arborfolio.plans.ledger_queries import financing_nodes
from arborfolio.plans.panel_queries import rolling, train
from arborfolio.plans.registry import query, view
from arborfolio.plans.risk_queries import benchmark, covariances, means
from arborfolio.plans.risk_queries import pick as coefficients
from arborfolio.plans.tree_queries import slots
from arborfolio.sources.written import shared

KEY, PERIODS, AVERSION = ["fold_id"], 52, 2.5
OBJECTIVES = ("min_risk", "max_return", "max_utility", "max_ratio")
#: A fold's target is this share of the way from its least to its greatest volatility on the path.
SHARES = (0.0, 0.25, 0.6, 0.9)
#: How far slopes and sums may be off in the checks of optimality.
LOOSE = 1e-8


def series(spark, sf):
    return train(spark, sf).select("fold_id", "instrument", "date", "ret")


@shared
def steps(spark, sf):
    return fr.frontier(series(spark, sf), bounds(spark, sf), KEY, reference=benchmark(spark, sf))


@shared
def best_of(spark, sf):
    picked = [fr.pick(steps(spark, sf), KEY, o, AVERSION).withColumn("objective", F.lit(o)) for o in OBJECTIVES]
    out = picked[0]
    for p in picked[1:]:
        out = out.unionByName(p)
    return out


@query("frontier_breakpoints", "SELECT fold_id, count(*) > 1 AS has_path, true AS rising FROM mu_e GROUP BY 1")
def frontier_breakpoints(spark, sf):
    """Each fold's path has breakpoints of rising mean and variance."""
    s = fr.stretches(steps(spark, sf).where("NOT beyond"), KEY)
    up = (F.col("next_expected") >= F.col("expected") - LOOSE) & (F.col("next_variance") >= F.col("variance") - LOOSE)
    return s.groupBy("fold_id").agg((F.count("*") >= 1).alias("has_path"), F.bool_and(up).alias("rising"))


@query("frontier_max_return", "SELECT fold_id, round(sum(weight * mu), 8) + 0.0 AS expected FROM max_return_w GROUP BY 1")
def frontier_max_return(spark, sf):
    """The end of each path is the highest mean that filling by mean gives."""
    return best_of(spark, sf).where("objective = 'max_return'").select("fold_id", rounded(F.col("expected"), 8).alias("expected"))


@query("frontier_optimality", "SELECT fold_id, objective, true AS optimal FROM (SELECT DISTINCT fold_id FROM mu_e) CROSS JOIN (VALUES " + ", ".join(f"('{o}')" for o in OBJECTIVES) + ") o(objective)")
def frontier_optimality(spark, sf):
    """Whether no shift of weight between two instruments improves the objective, by slopes from the moments' own tables."""
    key = ["fold_id", "objective"]
    held = fr.weights_of(best_of(spark, sf), key)
    risk = covariances(spark, sf).join(held.withColumnRenamed("instrument", "j"), ["fold_id", "j"]).groupBy(*key, "i").agg(F.sum(F.col("cov") * F.col("weight")).alias("risk"))
    rows = held.join(risk.withColumnRenamed("i", "instrument"), [*key, "instrument"]).join(means(spark, sf), ["fold_id", "instrument"]).join(bounds(spark, sf), "instrument")
    whole = rows.groupBy(key).agg(F.sum(F.col("weight") * F.col("mu")).alias("e"), F.sum(F.col("weight") * F.col("risk")).alias("v"), F.sum("weight").alias("total"))
    o = F.col("objective")
    slope = F.when(o == "min_risk", F.col("risk")).when(o == "max_return", -F.col("mu")).when(o == "max_utility", AVERSION * F.col("risk") - F.col("mu")).otherwise(F.col("e") / F.col("v") * F.col("risk") - F.col("mu"))
    gaps = rows.join(whole, key).withColumn("slope", slope).groupBy(key).agg(
        F.max(F.when(F.col("weight") > F.col("lo") + LOOSE, F.col("slope"))).alias("from_"), F.min(F.when(F.col("weight") < F.col("hi") - LOOSE, F.col("slope"))).alias("to_"),
        F.first("total").alias("total"), F.bool_and((F.col("weight") >= F.col("lo") - LOOSE) & (F.col("weight") <= F.col("hi") + LOOSE)).alias("inside"), F.first("e").alias("e"),
    )
    even = F.coalesce(F.col("from_") <= F.col("to_") + LOOSE, F.lit(True)) | ((o == "max_ratio") & (F.col("e") <= 0))
    return gaps.select(*key, (even & F.col("inside") & (F.abs(F.col("total") - 1) < LOOSE)).alias("optimal"))


# Exact volatility


def targeted(spark, sf):
    """The breakpoints of each fold under targets between the volatilities of its ends, and one that no portfolio has."""
    s = steps(spark, sf)
    ends = s.groupBy("fold_id").agg(F.sqrt(F.min("real")).alias("low"), F.sqrt(F.max("real")).alias("high"))
    goals = F.explode(F.array(*(F.struct(F.lit(f"share {x}").alias("goal"), (F.col("low") + x * (F.col("high") - F.col("low"))).alias("target")) for x in SHARES), F.struct(F.lit("too low").alias("goal"), (F.col("low") * 0.5).alias("target")))).alias("g")
    return s.join(ends.select("fold_id", goals).select("fold_id", "g.*"), "fold_id")


@shared
def exact(spark, sf):
    rows = targeted(spark, sf)
    picked = fr.pick(rows, ["fold_id", "goal"], "max_return", target=F.col("target"), hard_fail=True)
    return picked.join(rows.select("fold_id", "goal", "target").distinct(), ["fold_id", "goal"])


@query("select_exact_target", "SELECT fold_id, goal, CASE WHEN goal = 'too low' THEN 'failed' ELSE 'exact' END AS mode, goal <> 'too low' AS met FROM (SELECT DISTINCT fold_id FROM mu_e) CROSS JOIN (VALUES " + ", ".join(f"('share {x}')" for x in SHARES) + ", ('too low')) g(goal)")
def select_exact_target(spark, sf):
    """Rows with the exact volatility, measured again from the training rows, and error rows of the goals that can't be had."""
    key = ["fold_id", "goal"]
    days = fr.weights_of(exact(spark, sf), key).join(series(spark, sf), ["fold_id", "instrument"]).groupBy(*key, "date").agg(F.sum(F.col("weight") * F.col("ret")).alias("r"))
    real = days.groupBy(key).agg(F.stddev_samp("r").alias("vol"))
    told = exact(spark, sf).join(real, key, "left")
    met = F.coalesce(F.abs(F.col("vol") - F.col("target")) <= fr.TOLERANCE, F.lit(False))
    return told.select(*key, F.when(F.col("route") == "failed", "failed").otherwise("exact").alias("mode"), met.alias("met"))


# Caps on the tracking error

TE_CAP = 0.004


@shared
def capped(spark, sf):
    return fr.capped(series(spark, sf), bounds(spark, sf), benchmark(spark, sf), KEY, "max_utility", TE_CAP, AVERSION)


@query("tracking_capped_allocation", "SELECT fold_id, true AS within, true AS lagrange FROM mu_e GROUP BY 1")
def tracking_capped_allocation(spark, sf):
    """Whether the cap holds on the training rows, unless none can, and whether no shift of weight improves utility less the priced error."""
    c = capped(spark, sf)
    held = fr.weights_of(c, KEY).join(benchmark(spark, sf).withColumnRenamed("weight", "base"), "instrument", "left").withColumn("over", F.col("weight") - F.coalesce("base", F.lit(0.0)))
    days = held.join(series(spark, sf), ["fold_id", "instrument"]).groupBy("fold_id", "date").agg(F.sum(F.col("over") * F.col("ret")).alias("gap"))
    real = days.groupBy("fold_id").agg(F.stddev_samp("gap").alias("te"))
    risk = covariances(spark, sf).join(held.select("fold_id", F.col("instrument").alias("j"), "weight", "over"), ["fold_id", "j"]).groupBy("fold_id", F.col("i").alias("instrument"))
    risk = risk.agg(F.sum(F.col("cov") * F.col("weight")).alias("risk"), F.sum(F.col("cov") * F.col("over")).alias("off"))
    rows = held.join(risk, ["fold_id", "instrument"]).join(means(spark, sf), ["fold_id", "instrument"]).join(bounds(spark, sf), "instrument").join(c.select("fold_id", "multiplier", "status"), "fold_id")
    v = F.col("multiplier")
    slope = F.when(v.isNull(), F.col("off")).otherwise((AVERSION * F.col("risk") - F.col("mu") + v * F.col("off")) / (1 + v))
    even = rows.withColumn("slope", slope).groupBy("fold_id").agg(
        F.max(F.when(F.col("weight") > F.col("lo") + LOOSE, F.col("slope"))).alias("from_"), F.min(F.when(F.col("weight") < F.col("hi") - LOOSE, F.col("slope"))).alias("to_"), F.first("status").alias("status")
    )
    within = (F.col("te") <= TE_CAP + fr.TOLERANCE) | (F.col("status") == "nearest")
    return even.join(real, "fold_id").select("fold_id", within.alias("within"), F.coalesce(F.col("from_") <= F.col("to_") + 1e-7, F.lit(True)).alias("lagrange"))


@query("allocation_full_audit", "SELECT fold_id, 'exact' AS kind, CASE WHEN goal = 'too low' THEN 'failed' ELSE 'met' END AS target_status, 'not_requested' AS tev_status, true AS inside FROM (SELECT DISTINCT fold_id FROM mu_e) CROSS JOIN (VALUES ('share 0.25'), ('too low')) g(goal) UNION ALL SELECT DISTINCT fold_id, 'capped', 'not_requested', 'met', true FROM mu_e")
def allocation_full_audit(spark, sf):
    b, year = bounds(spark, sf), PERIODS**0.5
    wanted = exact(spark, sf).where("goal IN ('share 0.25', 'too low')").withColumn("annual", F.col("target") * year)
    aimed = fr.full_audit(wanted, b, ["fold_id", "goal"], PERIODS, "max_return", target=F.col("annual"))
    limited = fr.full_audit(capped(spark, sf), b, KEY, PERIODS, "max_utility", te_cap=_cap(spark, sf) * year, aversion=AVERSION)
    inside = F.coalesce((F.col("lower_slack") > -LOOSE) & (F.col("upper_slack") > -LOOSE) & (F.abs(F.col("sum_weights") - 1) < LOOSE), F.lit(True))
    out = lambda rows, kind: rows.select("fold_id", F.lit(kind).alias("kind"), "target_status", "tev_status", inside.alias("inside"))
    return out(aimed, "exact").unionByName(out(limited, "capped"))


def _cap(spark, sf):
    """The cap, or the least error that every fold can have where that is more."""
    nearest = capped(spark, sf).where("status = 'nearest'").agg(F.sqrt(F.max("tev"))).first()[0]
    return max(TE_CAP, nearest or 0.0)


# Views with and without

VIEWS = (("strong", 0.02 / 52, 0.6), ("as before", None, 0.6))


@query("view_effects", "SELECT fold_id, view_id, CASE WHEN view_id = 'as before' THEN 'no effect on weights' END AS problem FROM (SELECT DISTINCT fold_id FROM mu_e) CROSS JOIN (VALUES ('as before')) v(view_id)")
def view_effects(spark, sf):
    """A view that states what the means say already leaves the weights alone; a warning row tells so."""
    cov, mu, chosen = covariances(spark, sf), means(spark, sf), coefficients(spark, sf)
    rows = [single_view_mean(cov, mu, chosen, q, c).select("fold_id", F.lit(n).alias("view_id"), "instrument", "mu") if q is not None else mu.select("fold_id", F.lit(n).alias("view_id"), "instrument", "mu") for n, q, c in VIEWS]
    told = fr.view_effects(series(spark, sf), bounds(spark, sf), rows[0].unionByName(rows[1]), KEY, "max_utility", AVERSION)
    return told.where("problem IS NOT NULL AND view_id = 'as before'").select("fold_id", "view_id", "problem")


@query("view_weight_moves")
def view_weight_moves(spark, sf):
    """How far a stated view moves the weights of each fold."""
    viewed = single_view_mean(covariances(spark, sf), means(spark, sf), coefficients(spark, sf), VIEWS[0][1], VIEWS[0][2]).select("fold_id", F.lit("strong").alias("view_id"), "instrument", "mu")
    return fr.view_effects(series(spark, sf), bounds(spark, sf), viewed, KEY, "max_utility", AVERSION)


# Financing regimes, solved

LEVERAGE = 1.5


@shared
def financed(spark, sf):
    nodes = financing_nodes(spark, sf).where("is_root")
    cash = le.financing_returns(rolling(spark, sf).select(F.col("signal").alias("date")), nodes).groupBy().pivot("instrument", ["cash:RF", "cash:BORROW"]).agg(F.max("ret"))
    rates = rolling(spark, sf).select("fold_id").join(cash.select((F.col("cash:RF") * le.DAYS / PERIODS).alias("lend"), (F.col("cash:BORROW") * le.DAYS / PERIODS + 0.0002).alias("borrow")))
    return fr.financing(series(spark, sf), bounds(spark, sf).select("instrument", F.lit(0.0).alias("lo"), F.lit(LEVERAGE).alias("hi")), rates, KEY, "max_utility", LEVERAGE, AVERSION)[1]


@query("financing_solved_choice", f"SELECT DISTINCT fold_id, true AS signed, true AS no_worse, true AS bounded FROM mu_e WHERE {LEVERAGE} > 1")
def financing_solved_choice(spark, sf):
    """The better of the solved regimes: its cash has the regime's sign, it is no worse than any single instrument, and no leg leaves its bounds."""
    alone = covariances(spark, sf).where("i = j").select("fold_id", F.col("i").alias("instrument"), "cov").join(means(spark, sf), ["fold_id", "instrument"])
    single = alone.groupBy("fold_id").agg(F.max(F.col("mu") - AVERSION / 2 * F.col("cov")).alias("single"))
    rate = financing_nodes(spark, sf).where("is_root").select((F.col("risk_free") / PERIODS).alias("lend"))
    r, cash = F.col("regime"), F.col("cash")
    signed = F.when(r == "fully_invested", F.abs(cash) < 1e-10).when(r == "lend", cash > 0).otherwise(cash < 0)
    return financed(spark, sf).join(single, "fold_id").join(rate).select(
        "fold_id", signed.alias("signed"), (F.col("score") >= F.col("single") - F.col("lend") - LOOSE).alias("no_worse"), ((cash >= 1 - LEVERAGE - LOOSE) & (cash <= 1 + LOOSE)).alias("bounded")
    )


# The tree under another objective, through the same passes

view("tree_folds", "SELECT DISTINCT fold_id FROM mu_e")


@shared
def tree_by_utility(spark, sf):
    allocate = fr.allocator("max_utility", AVERSION)
    forward = hi.forward_pass(slots(spark)[0], series(spark, sf), allocate)
    return forward.withColumn("way", F.lit("forward")).unionByName(hi.backward_pass(*slots(spark), series(spark, sf), allocate, forward).withColumn("way", F.lit("backward")))


@query("tree_utility_weights", "SELECT fold_id, way, node_id, true AS budget, true AS inside FROM tree_folds CROSS JOIN (SELECT DISTINCT node_id FROM slots) CROSS JOIN (VALUES ('forward'), ('backward')) w(way)")
def tree_utility_weights(spark, sf):
    rows = tree_by_utility(spark, sf).join(slots(spark)[0].select("node_id", "lo", "hi").distinct(), "node_id")
    inside = F.bool_and((F.col("weight") >= F.col("lo") - LOOSE) & (F.col("weight") <= F.col("hi") + LOOSE))
    return rows.groupBy("fold_id", "way", "node_id").agg((F.abs(F.sum("weight") - 1) < LOOSE).alias("budget"), inside.alias("inside"))


@query("tree_utility_allocation")
def tree_utility_allocation(spark, sf):
    weights = tree_by_utility(spark, sf)
    top = slots(spark)[1].where("depth = 0").select("node_id")
    held = [hi.terminal_weights(weights.where(F.col("way") == w).drop("way"), top).select(F.lit(w).alias("way"), "fold_id", "instrument", rounded(F.col("weight"), 8).alias("weight")) for w in ("forward", "backward")]
    return held[0].unionByName(held[1])
