"""Queries on moments and views."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborfolio.functions.periods import rounded
from arborfolio.operators import folds as fo
from arborfolio.operators import moments as mo
from arborfolio.plans.panel_queries import estimation, rolling, train
from arborfolio.plans.registry import query, view
from arborfolio.sources.prices import table
from arborfolio.sources.written import shared

DIGITS = 10


def out(frame, *keys, **values):
    return frame.select(*keys, *(rounded(F.col(c), DIGITS).alias(n) for n, c in values.items()))


view("mu_e", "SELECT fold_id, instrument, avg(ret) AS mu FROM train GROUP BY ALL")
view("pair_rows", "SELECT a.fold_id, a.date, a.instrument AS i, b.instrument AS j, a.ret AS x, b.ret AS y FROM train a JOIN train b USING (fold_id, date)")
view("cov_s", "SELECT fold_id, i, j, covar_samp(x, y) AS cov FROM pair_rows GROUP BY ALL")
view("cov_p", "SELECT fold_id, i, j, covar_pop(x, y) AS cov FROM pair_rows GROUP BY ALL")
view("cov_f", "SELECT fold_id, i, j, 0.9 * cov + CASE WHEN i = j THEN 0.1 * (SELECT avg(t.cov) FROM cov_p t WHERE t.i = t.j AND t.fold_id = c.fold_id) ELSE 0 END AS cov FROM cov_p c")
view("bench", "SELECT 'ticker:' || upper(p_type) AS instrument, count(*) / (SELECT count(*) FROM part) AS weight FROM part GROUP BY 1")


def benchmark(spark, sf):
    p = table(spark, sf, "part")
    share = p.groupBy(F.concat(F.lit("ticker:"), F.upper("p_type")).alias("instrument")).agg(F.count("*").alias("n"))
    return share.crossJoin(F.broadcast(p.agg(F.count("*").alias("all_")))).select("instrument", (F.col("n") / F.col("all_")).alias("weight"))


@shared
def means(spark, sf):
    return mo.mean(train(spark, sf))


@shared
def sums(spark, sf):
    e = estimation(spark, sf)
    return mo.fold_sums(e, rolling(spark, sf), fo.estimation_ordinals(e))


@shared
def covariances(spark, sf):
    return mo.covariance_of_sums(sums(spark, sf))


@query("mean_empirical", f"SELECT fold_id, instrument, round(mu, {DIGITS}) + 0.0 AS mu FROM mu_e")
def mean_empirical(spark, sf):
    return out(means(spark, sf), "fold_id", "instrument", mu="mu")


@query("cov_sample", f"SELECT fold_id, i, j, round(cov, {DIGITS}) + 0.0 AS cov FROM cov_s")
def cov_sample(spark, sf):
    return out(covariances(spark, sf), "fold_id", "i", "j", cov="cov")


@query("cov_sample_prefix_sums", f"SELECT fold_id, i, j, round(cov, {DIGITS}) + 0.0 AS cov FROM cov_s")
def cov_sample_prefix_sums(spark, sf):
    e = estimation(spark, sf)
    return out(mo.rolling_covariance(e, rolling(spark, sf), fo.estimation_ordinals(e)), "fold_id", "i", "j", cov="cov")


@query("cov_expanding", f"SELECT fold_id, i, j, round(covar_samp(x, y), {DIGITS}) + 0.0 AS cov FROM (SELECT a.fold_id, a.instrument AS i, b.instrument AS j, a.ret AS x, b.ret AS y FROM train_expanding a JOIN train_expanding b USING (fold_id, date)) GROUP BY ALL")
def cov_expanding(spark, sf):
    """Sample covariances of folds that train on all periods so far."""
    e = estimation(spark, sf)
    return out(mo.rolling_covariance(e, rolling(spark, sf, True), fo.estimation_ordinals(e)), "fold_id", "i", "j", cov="cov")


@query("cov_shrunk_fixed", f"SELECT fold_id, i, j, round(cov, {DIGITS}) + 0.0 AS cov FROM cov_f")
def cov_shrunk_fixed(spark, sf):
    return out(mo.shrunk(mo.covariance_of_sums(sums(spark, sf), ddof=0)), "fold_id", "i", "j", cov="cov")


@query("cov_ledoit_wolf", f"""WITH c AS (SELECT t.fold_id, t.date, t.instrument, t.ret - m.mu AS ret FROM train t JOIN mu_e m USING (fold_id, instrument)),
s AS (SELECT a.fold_id, a.instrument AS i, b.instrument AS j, avg(a.ret * b.ret) AS cov, avg(a.ret * a.ret * b.ret * b.ret) AS fourth, count(*) AS n FROM c a JOIN c b USING (fold_id, date) GROUP BY ALL),
l AS (SELECT fold_id, avg(cov) AS level FROM s WHERE i = j GROUP BY 1),
d AS (SELECT s.*, CASE WHEN i = j THEN level ELSE 0 END AS target FROM s JOIN l USING (fold_id)),
w AS (SELECT fold_id, least(sum((fourth - cov * cov) / n), sum((cov - target) ** 2)) / sum((cov - target) ** 2) AS delta FROM d GROUP BY 1)
SELECT fold_id, i, j, round((1 - delta) * cov + delta * target, {DIGITS}) + 0.0 AS cov FROM d JOIN w USING (fold_id)""")
def cov_ledoit_wolf(spark, sf):
    return out(mo.ledoit_wolf_of_sums(sums(spark, sf)), "fold_id", "i", "j", cov="cov")


@query("corr_distance", "SELECT fold_id, i, j, round(corr(x, y), 8) + 0.0 AS rho, round(sqrt(greatest((1 - corr(x, y)) / 2, 0)), 8) + 0.0 AS distance FROM pair_rows WHERE i < j GROUP BY fold_id, i, j")
def corr_distance(spark, sf):
    return mo.correlation_distance_of_sums(sums(spark, sf)).select("fold_id", "i", "j", rounded(F.col("rho"), 8).alias("rho"), rounded(F.col("distance"), 8).alias("distance"))


view("mu_q", "SELECT fold_id, i AS instrument, 2.5 * sum(cov * weight) + 0.0004 AS mu FROM cov_s JOIN bench ON j = instrument GROUP BY ALL")


@query("mean_equilibrium", f"SELECT fold_id, instrument, round(mu, {DIGITS}) + 0.0 AS mu FROM mu_q")
def mean_equilibrium(spark, sf):
    return out(mo.equilibrium_mean(covariances(spark, sf), benchmark(spark, sf), 2.5, 0.0004), "fold_id", "instrument", mu="mu")


@query("mean_reference_gaps", """WITH ref AS (SELECT DISTINCT 'ticker:' || upper(CASE WHEN p_size > 45 THEN p_brand ELSE p_type END) AS instrument FROM part WHERE p_size > 45 OR p_type < 'P')
SELECT instrument, 'missing' AS problem FROM (SELECT DISTINCT instrument FROM type_levels) WHERE instrument NOT IN (SELECT instrument FROM ref)
UNION ALL SELECT instrument, 'unknown' FROM ref WHERE instrument NOT IN (SELECT instrument FROM type_levels)""")
def mean_reference_gaps(spark, sf):
    from arborfolio.sources.prices import type_levels

    p = table(spark, sf, "part").where("p_size > 45 OR p_type < 'P'")
    reference = p.select(F.concat(F.lit("ticker:"), F.upper(F.when(F.col("p_size") > 45, F.col("p_brand")).otherwise(F.col("p_type")))).alias("instrument")).distinct()
    return mo.reference_gaps(type_levels(spark, sf), reference)


@query("mean_shrunk")
def mean_shrunk(spark, sf):
    rows = train(spark, sf)
    parts = [mo.shrunk_means(rows, m).withColumn("method", F.lit(m)) for m in ("bayes_stein", "james_stein", "bodnar_okhrin")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


NODE_SETTINGS = """SELECT c_custkey AS node_id, CASE c_custkey % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'equilibrium' ELSE 'empirical' END AS estimator,
  CASE WHEN c_custkey % 5 = 0 THEN 'max_utility' ELSE 'min_risk' END AS objective, c_acctbal > 0 AS full_reference, c_nationkey % 2 = 0 AS has_cash FROM customer"""
view("node_settings", NODE_SETTINGS)


def node_settings(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        k.alias("node_id"),
        F.when(k % 3 == 0, "auto").when(k % 3 == 1, "equilibrium").otherwise("empirical").alias("estimator"),
        F.when(k % 5 == 0, "max_utility").otherwise("min_risk").alias("objective"),
        (F.col("c_acctbal") > 0).alias("full_reference"),
        (F.col("c_nationkey") % 2 == 0).alias("has_cash"),
    )


@query("resolved_mean_estimator", """SELECT node_id, CASE WHEN estimator <> 'auto' THEN estimator WHEN objective = 'max_utility' OR has_cash THEN 'bayes_stein' WHEN full_reference THEN 'equilibrium' ELSE 'bayes_stein' END AS resolved,
  CASE WHEN estimator <> 'auto' THEN 'declared' WHEN objective = 'max_utility' THEN 'utility objective' WHEN has_cash THEN 'cash in node' WHEN full_reference THEN 'full reference' ELSE 'no full reference' END AS reason FROM node_settings""")
def resolved_mean_estimator(spark, sf):
    auto = F.col("estimator") == "auto"
    resolved = F.when(~auto, F.col("estimator")).when((F.col("objective") == "max_utility") | F.col("has_cash"), "bayes_stein").when(F.col("full_reference"), "equilibrium").otherwise("bayes_stein")
    reason = F.when(~auto, "declared").when(F.col("objective") == "max_utility", "utility objective").when(F.col("has_cash"), "cash in node").when(F.col("full_reference"), "full reference").otherwise("no full reference")
    return node_settings(spark, sf).select("node_id", resolved.alias("resolved"), reason.alias("reason"))


@query("moments_with_cash", f"""SELECT fold_id, i, j, round(cov, {DIGITS}) + 0.0 AS cov FROM cov_s UNION ALL SELECT DISTINCT fold_id, 'cash:RF', i, 0.0 FROM cov_s UNION ALL SELECT DISTINCT fold_id, i, 'cash:RF', 0.0 FROM cov_s
  UNION ALL SELECT DISTINCT fold_id, 'cash:RF', 'cash:RF', 0.0 FROM cov_s UNION ALL SELECT fold_id, instrument, 'mean', round(mu, {DIGITS}) + 0.0 FROM mu_e UNION ALL SELECT DISTINCT fold_id, 'cash:RF', 'mean', round(0.03 / 52, {DIGITS}) FROM mu_e""")
def moments_with_cash(spark, sf):
    mu, cov = mo.with_cash(means(spark, sf), covariances(spark, sf), 0.03 / 52)
    return out(cov.unionByName(mu.select("fold_id", F.col("instrument").alias("i"), F.lit("mean").alias("j"), F.col("mu").alias("cov"))), "fold_id", "i", "j", cov="cov")


@query("portfolio_vol_both", f"""SELECT * FROM (SELECT fold_id, round(stddev_samp(r), {DIGITS}) AS realized FROM (SELECT fold_id, date, sum(ret * weight) AS r FROM train JOIN bench USING (instrument) GROUP BY ALL) GROUP BY 1)
  JOIN (SELECT fold_id, round(sqrt(sum(a.weight * b.weight * cov)), {DIGITS}) AS model FROM cov_s JOIN bench a ON i = a.instrument JOIN bench b ON j = b.instrument GROUP BY 1) USING (fold_id)""")
def portfolio_vol_both(spark, sf):
    rows = train(spark, sf)
    return out(mo.portfolio_volatility(rows, covariances(spark, sf), benchmark(spark, sf)), "fold_id", realized="realized", model="model")


# Views: promo over economy, at 2 % a year (weekly), with confidence 0.6

Q, CONFIDENCE = 0.02 / 52, 0.6
view("pick", "SELECT instrument, CASE instrument WHEN 'ticker:PROMO' THEN 1.0 ELSE -1.0 END AS coef FROM (SELECT DISTINCT instrument FROM type_levels) WHERE instrument IN ('ticker:PROMO', 'ticker:ECONOMY')")
view("push", "SELECT fold_id, i AS instrument, sum(cov * coef) AS push FROM cov_s JOIN pick ON j = instrument GROUP BY ALL")
view("view_scalars", "SELECT a.fold_id, a.spread, b.prior FROM (SELECT fold_id, sum(coef * push) AS spread FROM push JOIN pick USING (instrument) GROUP BY 1) a JOIN (SELECT fold_id, sum(coef * mu) AS prior FROM mu_e JOIN pick USING (instrument) GROUP BY 1) b USING (fold_id)")
view("mu_post", f"SELECT fold_id, instrument, mu + {CONFIDENCE} * push * ({Q!r} - prior) / spread AS mu FROM mu_e JOIN push USING (fold_id, instrument) JOIN view_scalars USING (fold_id)")


def pick(spark, sf):
    from arborfolio.sources.prices import type_levels

    names = type_levels(spark, sf).select("instrument").distinct().where("instrument IN ('ticker:PROMO', 'ticker:ECONOMY')")
    return names.select("instrument", F.when(F.col("instrument") == "ticker:PROMO", 1.0).otherwise(-1.0).alias("coef"))


@query("bl_single_view_mean", f"SELECT fold_id, instrument, round(mu, {DIGITS}) + 0.0 AS mu FROM mu_post")
def bl_single_view_mean(spark, sf):
    return out(mo.single_view_mean(covariances(spark, sf), means(spark, sf), pick(spark, sf), Q, CONFIDENCE), "fold_id", "instrument", mu="mu")


@query("bl_single_view_cov", f"""SELECT fold_id, i, j, round(cov + 0.05 * (cov - {CONFIDENCE} * a.push * b.push / spread), {DIGITS}) + 0.0 AS cov FROM cov_s
  JOIN push a USING (fold_id) JOIN push b USING (fold_id) JOIN view_scalars USING (fold_id) WHERE a.instrument = i AND b.instrument = j""")
def bl_single_view_cov(spark, sf):
    return out(mo.single_view_cov(covariances(spark, sf), means(spark, sf), pick(spark, sf), CONFIDENCE), "fold_id", "i", "j", cov="cov")


@query("bl_view_details", """SELECT fold_id, round(52 * prior, 8) + 0.0 AS prior_view, round(52 * post, 8) + 0.0 AS posterior_view FROM view_scalars
  JOIN (SELECT fold_id, sum(coef * mu) AS post FROM mu_post JOIN pick USING (instrument) GROUP BY 1) USING (fold_id)""")
def bl_view_details(spark, sf):
    done = mo.view_details(covariances(spark, sf), means(spark, sf), pick(spark, sf), Q, CONFIDENCE, 52)
    return done.select("fold_id", rounded(F.col("prior_view"), 8).alias("prior_view"), rounded(F.col("posterior_view"), 8).alias("posterior_view"))


@query("bl_multi_view")
def bl_multi_view(spark, sf):
    stated = [(1, "ticker:PROMO", 1.0, Q, 0.6), (1, "ticker:ECONOMY", -1.0, Q, 0.6), (2, "ticker:SMALL", 1.0, 0.001, 0.3)]
    views = spark.createDataFrame(stated, "view_id int, instrument string, coef double, q double, confidence double")
    return mo.multi_view_mean(covariances(spark, sf), means(spark, sf), views)


VIEW_ROWS = """SELECT o_custkey AS node_id, o_orderkey AS view_id, CASE WHEN o_orderkey % 50 = 7 THEN 'cash:RF' ELSE o_orderpriority END AS instrument,
  CASE WHEN o_orderkey % 11 = 0 THEN 0.0 WHEN o_orderkey % 2 = 0 THEN 1.0 ELSE -1.0 END AS coef, CASE WHEN o_totalprice > 400000 THEN 1.5 WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice / 1000000 END AS q FROM orders"""


@query("view_issues", f"""WITH v AS ({VIEW_ROWS}), u AS (SELECT DISTINCT o_custkey AS node_id, o_orderpriority AS instrument FROM orders WHERE o_orderpriority < '4')
SELECT DISTINCT node_id, view_id, 'financing_target' AS issue FROM v WHERE starts_with(instrument, 'cash:')
UNION ALL SELECT DISTINCT node_id, view_id, 'outside_universe' FROM v WHERE NOT starts_with(instrument, 'cash:') AND (node_id, instrument) NOT IN (SELECT (node_id, instrument) FROM u)
UNION ALL SELECT DISTINCT node_id, view_id, 'non_finite' FROM v WHERE q IS NULL
UNION ALL SELECT DISTINCT node_id, view_id, 'all_zero' FROM v WHERE coef = 0
UNION ALL SELECT DISTINCT a.node_id, a.view_id, 'duplicate' FROM v a JOIN v b ON a.node_id = b.node_id AND a.view_id > b.view_id AND a.instrument = b.instrument AND a.coef = b.coef
UNION ALL SELECT DISTINCT a.node_id, a.view_id, 'opposite' FROM v a JOIN v b ON a.node_id = b.node_id AND a.view_id > b.view_id AND a.instrument = b.instrument AND a.coef = -b.coef
UNION ALL SELECT DISTINCT node_id, view_id, 'extreme_return' FROM v WHERE abs(q) > 1""")
def view_issues(spark, sf):
    o = table(spark, sf, "orders")
    rows = o.selectExpr("o_custkey AS node_id", "o_orderkey AS view_id", "IF(o_orderkey % 50 = 7, 'cash:RF', o_orderpriority) AS instrument", "CASE WHEN o_orderkey % 11 = 0 THEN 0.0D WHEN o_orderkey % 2 = 0 THEN 1.0D ELSE -1.0D END AS coef", "CASE WHEN o_totalprice > 400000 THEN 1.5D WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice / 1000000 END AS q")
    universe = o.where("o_orderpriority < '4'").select(F.col("o_custkey").alias("node_id"), F.col("o_orderpriority").alias("instrument")).distinct()
    return mo.view_issues(rows, universe)


WEIGHTS = "SELECT o_custkey AS node_id, o_orderpriority AS instrument, sum(CASE WHEN {c} THEN o_totalprice ELSE 0 END) / sum(sum(CASE WHEN {c} THEN o_totalprice ELSE 0 END)) OVER (PARTITION BY o_custkey) AS weight FROM orders WHERE {c} GROUP BY 1, 2"
view("w_before", WEIGHTS.format(c="o_orderstatus <> 'F'"))
view("w_after", WEIGHTS.format(c="o_orderstatus <> 'O'"))
view("w_delta", "SELECT node_id, instrument, coalesce(a.weight, 0) AS before, coalesce(b.weight, 0) AS after, coalesce(b.weight, 0) - coalesce(a.weight, 0) AS delta FROM w_before a FULL JOIN w_after b USING (node_id, instrument)")


def two_weights(spark, sf):
    from pyspark.sql import Window

    def one(condition):
        summed = table(spark, sf, "orders").where(condition).groupBy(F.col("o_custkey").alias("node_id"), F.col("o_orderpriority").alias("instrument")).agg(F.sum("o_totalprice").alias("s"))
        return summed.select("node_id", "instrument", (F.col("s") / F.sum("s").over(Window.partitionBy("node_id"))).alias("weight"))

    return mo.weight_delta(one("o_orderstatus <> 'F'"), one("o_orderstatus <> 'O'"), ["node_id"])


@query("counterfactual_delta", "SELECT node_id, instrument, round(before, 6) + 0.0 AS before, round(after, 6) + 0.0 AS after, round(delta, 6) + 0.0 AS delta FROM w_delta")
def counterfactual_delta(spark, sf):
    return two_weights(spark, sf).select("node_id", "instrument", *(rounded(F.col(c)).alias(c) for c in ("before", "after", "delta")))


@query("turnover_one_way", "SELECT node_id, round(0.5 * sum(abs(delta)), 6) + 0.0 AS turnover FROM w_delta GROUP BY 1")
def turnover_one_way(spark, sf):
    return mo.one_way_turnover(two_weights(spark, sf), ["node_id"]).select("node_id", rounded(F.col("turnover")).alias("turnover"))
