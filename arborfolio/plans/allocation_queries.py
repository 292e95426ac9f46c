"""Queries on bounds, allocation rules, screening and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborfolio.functions.periods import rounded
from arborfolio.operators import allocation as al
from arborfolio.plans.panel_queries import hold, rolling, train, valuation
from arborfolio.plans.registry import query, view
from arborfolio.plans.risk_queries import benchmark, covariances, means
from arborfolio.sources.prices import table, type_levels
from arborfolio.sources.written import shared

# Bounds of the fold portfolios by instrument, from the parts of its type

view("bounds", "SELECT 'ticker:' || upper(p_type) AS instrument, round(0.02 + avg(p_size) / 1000, 6) AS lo, round(0.25 + avg(p_size) / 200, 6) AS hi FROM part GROUP BY 1")
view("fold_bounds", "SELECT DISTINCT fold_id, b.* FROM folds_r CROSS JOIN bounds b")


def bounds(spark, sf):
    return table(spark, sf, "part").groupBy(F.concat(F.lit("ticker:"), F.upper("p_type")).alias("instrument")).agg(
        F.round(0.02 + F.avg("p_size") / 1000, 6).alias("lo"), F.round(0.25 + F.avg("p_size") / 200, 6).alias("hi")
    )


COMPONENTS = """SELECT c_custkey AS node_id, CASE WHEN c_custkey % 20 = 0 AND k = 1 THEN 'cash:RF' WHEN c_custkey % 20 = 1 AND k = 2 THEN 'cash:BORROW' ELSE 'ticker:A' || k END AS instrument,
  CASE WHEN (c_custkey + k) % 4 = 0 THEN round(abs(c_acctbal) / 19997, 6) END AS min_weight, CASE WHEN (c_custkey + k) % 3 = 0 THEN round(abs(c_acctbal) / 11987, 6) END AS max_weight,
  CASE WHEN c_nationkey % 2 = 0 THEN 0.45 END AS cap, 1.5 AS leverage FROM customer CROSS JOIN range(1, 4) r(k)"""
view("components_in", COMPONENTS)
view("node_bounds_v", """SELECT node_id, instrument, CASE WHEN starts_with(instrument, 'cash:BORROW') THEN 1 - leverage WHEN starts_with(instrument, 'cash:') THEN 0.0 ELSE coalesce(min_weight, 0.0) END AS lo,
  CASE WHEN starts_with(instrument, 'cash:BORROW') THEN 0.0 WHEN starts_with(instrument, 'cash:') THEN 1.0 ELSE least(coalesce(max_weight, 1.0), coalesce(cap, 1.0), 1.0) END AS hi FROM components_in""")


def components(spark, sf):
    c = table(spark, sf, "customer").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(3))))
    n = F.col("c_custkey")
    name = F.when((n % 20 == 0) & (F.col("k") == 1), "cash:RF").when((n % 20 == 1) & (F.col("k") == 2), "cash:BORROW").otherwise(F.concat(F.lit("ticker:A"), F.col("k").cast("string")))
    return c.select(
        n.alias("node_id"),
        name.alias("instrument"),
        F.when((n + F.col("k")) % 4 == 0, F.round(F.abs("c_acctbal") / 19997, 6)).alias("min_weight"),
        F.when((n + F.col("k")) % 3 == 0, F.round(F.abs("c_acctbal") / 11987, 6)).alias("max_weight"),
        F.when(F.col("c_nationkey") % 2 == 0, 0.45).alias("cap"),
        F.lit(1.5).alias("leverage"),
    )


@query("node_bounds", "SELECT node_id, instrument, round(lo, 6) + 0.0 AS lo, round(hi, 6) + 0.0 AS hi FROM node_bounds_v")
def node_bounds(spark, sf):
    return al.node_bounds(components(spark, sf)).withColumns({c: rounded(F.col(c)) for c in ("lo", "hi")})


@query("bound_violations", f"""SELECT DISTINCT node_id, 'crossed' AS problem FROM node_bounds_v WHERE lo > hi
  UNION ALL SELECT node_id, 'lower bounds exceed the budget' FROM node_bounds_v GROUP BY 1 HAVING sum(lo) > 1 + {al.TOLERANCE}
  UNION ALL SELECT node_id, 'upper bounds miss the budget' FROM node_bounds_v GROUP BY 1 HAVING sum(hi) < 1 - {al.TOLERANCE}""")
def bound_violations(spark, sf):
    return al.bound_violations(al.node_bounds(components(spark, sf)))


def fill_sql(rows, keys, order):
    return f"SELECT *, lo + least(greatest(1 - sum(lo) OVER (PARTITION BY {keys}) - coalesce(sum(hi - lo) OVER (PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0), hi - lo) AS weight FROM {rows}"


view("max_return_w", fill_sql("(SELECT * FROM mu_e JOIN bounds USING (instrument))", "fold_id", "mu DESC, instrument"))
view("vertices", fill_sql("(SELECT f.fold_id, c.instrument AS candidate, b.* FROM (SELECT DISTINCT fold_id FROM mu_e) f CROSS JOIN bounds c CROSS JOIN bounds b)", "fold_id, candidate", "(instrument <> candidate), instrument"))


@shared
def best_return(spark, sf):
    return al.max_return(means(spark, sf), bounds(spark, sf), ["fold_id"])


@shared
def vertices(spark, sf):
    rows = means(spark, sf).select("fold_id").distinct().crossJoin(F.broadcast(bounds(spark, sf)))
    return al.vertex_candidates(rows, ["fold_id"])


@query("alloc_max_return", "SELECT fold_id, instrument, round(weight, 6) + 0.0 AS weight FROM max_return_w")
def alloc_max_return(spark, sf):
    return best_return(spark, sf).withColumn("weight", rounded(F.col("weight")))


@query("alloc_waterfill", """WITH RECURSIVE b AS (SELECT node_id, instrument, lo, hi - lo AS room FROM node_bounds_v WHERE node_id IN (SELECT node_id FROM node_bounds_v GROUP BY 1 HAVING bool_and(lo <= hi) AND sum(lo) <= 1 AND sum(hi) >= 1)),
k AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY node_id) AS n, 1 - sum(lo) OVER (PARTITION BY node_id) AS spare, coalesce(sum(room) OVER (PARTITION BY node_id ORDER BY room, instrument ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b WINDOW w AS (PARTITION BY node_id ORDER BY room, instrument)),
f AS (SELECT node_id, arg_min((spare - before) / (n - k + 1), k) AS level, min(k) AS at FROM k WHERE (spare - before) / (n - k + 1) <= room GROUP BY 1)
SELECT node_id, instrument, round(lo + CASE WHEN f.at IS NULL OR k.k < f.at THEN room ELSE least(room, greatest(level, 0)) END, 9) + 0.0 AS weight FROM k LEFT JOIN f USING (node_id)""")
def alloc_waterfill(spark, sf):
    b = al.node_bounds(components(spark, sf))
    fit = b.groupBy("node_id").agg(F.bool_and(F.col("lo") <= F.col("hi")).alias("ok"), F.sum("lo").alias("l"), F.sum("hi").alias("h")).where("ok AND l <= 1 AND h >= 1")
    return al.water_fill(b.join(fit, "node_id", "left_semi"), ["node_id"]).withColumn("weight", rounded(F.col("weight"), 9))


@query("candidate_vertices", "SELECT fold_id, candidate, instrument, round(weight, 6) + 0.0 AS weight FROM vertices")
def candidate_vertices(spark, sf):
    return vertices(spark, sf).withColumn("weight", rounded(F.col("weight")))


view("screened", """SELECT * FROM (SELECT fold_id, candidate, sum(weight * mu) AS expected FROM vertices JOIN mu_e USING (fold_id, instrument) GROUP BY ALL)
  JOIN (SELECT a.fold_id, a.candidate, sqrt(sum(a.weight * b.weight * cov)) AS model_vol FROM cov_s c JOIN vertices a ON a.fold_id = c.fold_id AND a.instrument = i JOIN vertices b ON b.fold_id = c.fold_id AND b.candidate = a.candidate AND b.instrument = j GROUP BY ALL) USING (fold_id, candidate)
  JOIN (SELECT fold_id, candidate, stddev_samp(r) AS realized_vol, stddev_samp(r - b) AS tracking_error FROM (SELECT fold_id, candidate, date, sum(weight * ret) AS r FROM vertices JOIN train USING (fold_id, instrument) GROUP BY ALL)
    JOIN (SELECT fold_id, date, sum(weight * ret) AS b FROM bench JOIN train USING (instrument) GROUP BY ALL) USING (fold_id, date) GROUP BY ALL) USING (fold_id, candidate)""")


@shared
def screened(spark, sf):
    return al.screen(vertices(spark, sf), train(spark, sf), means(spark, sf), covariances(spark, sf), benchmark(spark, sf))


NUMBERS = ("expected", "model_vol", "realized_vol", "tracking_error")


@query("screen_candidates", "SELECT fold_id, candidate, " + ", ".join(f"round({n}, 8) + 0.0 AS {n}" for n in NUMBERS) + " FROM screened")
def screen_candidates(spark, sf):
    return screened(spark, sf).withColumns({n: rounded(F.col(n), 8) for n in NUMBERS})


SCORES = {"min_risk": "model_vol", "max_return": "-expected", "max_ratio": "-expected / model_vol", "max_utility": "-(expected - 1.25 * model_vol * model_vol)"}


def best_sql(objective, vol, te):
    return f"""SELECT fold_id, '{objective}' AS objective, candidate, te = 0 AND vo = 0 AS feasible FROM (SELECT *, row_number() OVER (PARTITION BY fold_id ORDER BY round(te, 10), round(vo, 10), round({SCORES[objective]}, 10), candidate) AS k FROM (
      SELECT *, CASE WHEN tracking_error - {te} > {al.TOLERANCE} THEN tracking_error - {te} ELSE 0 END AS te, CASE WHEN realized_vol - {vol} > {al.TOLERANCE} THEN realized_vol - {vol} ELSE 0 END AS vo FROM screened)) WHERE k = 1"""


def best(spark, sf, objective, vol, te):
    return al.select_best(screened(spark, sf), objective, vol, te).select("fold_id", F.lit(objective).alias("objective"), "candidate", "feasible")


@query("select_best", " UNION ALL ".join(best_sql(o, 0.05, 0.05) for o in SCORES))
def select_best(spark, sf):
    a, b, c, d = (best(spark, sf, o, 0.05, 0.05) for o in SCORES)
    return a.union(b).union(c).union(d)


@query("select_nearest_feasible", " UNION ALL ".join(best_sql(o, 0.004, 0.003) for o in SCORES))
def select_nearest_feasible(spark, sf):
    a, b, c, d = (best(spark, sf, o, 0.004, 0.003) for o in SCORES)
    return a.union(b).union(c).union(d)


@query("alloc_min_variance")
def alloc_min_variance(spark, sf):
    return al.minimum_variance(covariances(spark, sf))


view("canonical_w", "SELECT fold_id, instrument, weight / sum(weight) OVER (PARTITION BY fold_id) AS weight FROM (SELECT fold_id, instrument, CASE WHEN abs(weight) < 1e-10 THEN 0 ELSE weight END AS weight FROM max_return_w)")


@query("allocation_audit", """SELECT fold_id, round(sum(weight) - 1, 6) + 0.0 AS budget_error, round(min(weight - lo), 6) + 0.0 AS lower_slack, round(min(hi - weight), 6) + 0.0 AS upper_slack,
  CASE WHEN abs(sum(weight) - 1) > 1e-6 OR min(weight - lo) < -1e-6 OR min(hi - weight) < -1e-6 THEN 'violated' ELSE 'ok' END AS status FROM canonical_w JOIN bounds USING (instrument) GROUP BY 1""")
def allocation_audit(spark, sf):
    done = al.audit(al.canonical(best_return(spark, sf), ["fold_id"]), bounds(spark, sf), ["fold_id"])
    return done.withColumns({c: rounded(F.col(c)) for c in ("budget_error", "lower_slack", "upper_slack")})


REGIMES = "SELECT o_custkey AS node_id, CASE WHEN o_orderstatus = 'O' THEN 'borrow' ELSE 'lend' END AS regime, round(avg(o_totalprice), 8) AS score, CASE WHEN min(o_orderkey) % 3 = 0 THEN 0.0 ELSE 0.1 END AS cash FROM orders GROUP BY 1, 2"


@query("financing_regime_choice", f"""SELECT node_id, CASE WHEN abs(cash) < 1e-10 THEN 'fully_invested' ELSE regime END AS regime, round(score, 8) AS score FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY score DESC, regime) AS k FROM ({REGIMES})) WHERE k = 1""")
def financing_regime_choice(spark, sf):
    regime = F.when(F.col("o_orderstatus") == "O", "borrow").otherwise("lend")
    scored = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("node_id"), regime.alias("regime")).agg(
        F.round(F.avg("o_totalprice"), 8).alias("score"), F.when(F.min("o_orderkey") % 3 == 0, 0.0).otherwise(0.1).alias("cash")
    )
    return al.regime_choice(scored, "max_return").withColumn("score", F.round("score", 8))


SETTINGS = {"risk_free": 0.0, "cap": 1.0, "tau": 0.05}
view("settings_in", "SELECT c_custkey AS node_id, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal / 1000000 END AS risk_free, CASE WHEN c_custkey % 4 = 1 THEN 0.5 END AS cap, CAST(NULL AS DOUBLE) AS tau FROM customer")
view("settings_root", "SELECT min(c_acctbal) / 1000000 AS risk_free, CAST(NULL AS DOUBLE) AS cap, CAST(NULL AS DOUBLE) AS tau FROM customer")


@query("effective_settings", "SELECT s.node_id, " + ", ".join(f"round(coalesce(s.{c}, r.{c}, {d}), 6) + 0.0 AS {c}, CASE WHEN s.{c} IS NOT NULL THEN 'node' WHEN r.{c} IS NOT NULL THEN 'root' ELSE 'default' END AS {c}_source" for c, d in SETTINGS.items()) + " FROM settings_in s CROSS JOIN settings_root r")
def effective_settings(spark, sf):
    c = table(spark, sf, "customer")
    none = F.lit(None).cast("double")
    nodes = c.select(F.col("c_custkey").alias("node_id"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal") / 1000000).alias("risk_free"), F.when(F.col("c_custkey") % 4 == 1, 0.5).alias("cap"), none.alias("tau"))
    root = c.agg((F.min("c_acctbal") / 1000000).alias("risk_free")).select("risk_free", none.alias("cap"), none.alias("tau"))
    return al.effective_settings(nodes, root, SETTINGS).withColumns({n: rounded(F.col(n)) for n in SETTINGS})


@query("resolved_vol_targets", """WITH s AS (SELECT instrument AS reference, stddev_samp(ret) * sqrt(252.0) AS measured FROM type_valuation GROUP BY 1),
n AS (SELECT c_custkey AS node_id, CASE WHEN c_custkey % 5 = 0 THEN 0.1 END AS manual, CASE c_custkey % 3 WHEN 0 THEN 'ticker:PROMO' WHEN 1 THEN 'ticker:SMALL' ELSE 'ticker:NONE' END AS reference FROM customer)
SELECT node_id, round(coalesce(manual, measured), 6) AS target, CASE WHEN manual IS NOT NULL THEN 'manual' WHEN measured IS NOT NULL THEN reference ELSE 'none' END AS source FROM n LEFT JOIN s USING (reference)""")
def resolved_vol_targets(spark, sf):
    k = F.col("c_custkey")
    nodes = table(spark, sf, "customer").select(k.alias("node_id"), F.when(k % 5 == 0, 0.1).alias("manual"), F.when(k % 3 == 0, "ticker:PROMO").when(k % 3 == 1, "ticker:SMALL").otherwise("ticker:NONE").alias("reference"))
    series = valuation(spark, sf).select(F.col("instrument").alias("reference"), "ret")
    return al.volatility_targets(nodes, series, 252).withColumn("target", F.round("target", 6))
