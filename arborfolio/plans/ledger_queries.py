"""Queries on the ledger, metrics, pruning evidence and inference."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from arborfolio.functions.periods import rounded, years_after
from arborfolio.operators import folds as fo
from arborfolio.operators import inference as inf
from arborfolio.operators import ledger as le
from arborfolio.operators import pruning as pru
from arborfolio.plans.panel_queries import hold, rolling, valuation
from arborfolio.plans.registry import query, view
from arborfolio.plans.risk_queries import benchmark, means
from arborfolio.sources import exports as ex
from arborfolio.sources.prices import table
from arborfolio.sources.written import shared, shared_dir

BPS = 10.0

# Arms: equal weight, the declared benchmark, the best trailing mean, and half of each extreme

view("targets", """SELECT fold_id, 'EQUAL' AS arm, instrument, 1.0 / count(*) OVER (PARTITION BY fold_id) AS weight FROM mu_e
  UNION ALL SELECT fold_id, 'BENCH', instrument, weight FROM (SELECT DISTINCT fold_id FROM folds_r) CROSS JOIN bench
  UNION ALL SELECT fold_id, 'TOP', instrument, 1.0 FROM (SELECT *, row_number() OVER (PARTITION BY fold_id ORDER BY mu DESC, instrument) AS k FROM mu_e) WHERE k = 1
  UNION ALL SELECT fold_id, 'TOP2', instrument, 0.5 FROM (SELECT *, row_number() OVER (PARTITION BY fold_id ORDER BY mu DESC, instrument) AS k FROM mu_e) WHERE k <= 2""")
view("grown", """SELECT fold_id, arm, h.date, instrument, weight, product(1 + h.ret) OVER (PARTITION BY fold_id, arm, instrument ORDER BY h.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g
  FROM targets JOIN hold h USING (fold_id, instrument)""")
view("gross", """SELECT arm, fold_id, date, v / coalesce(lag(v) OVER (PARTITION BY arm, fold_id ORDER BY date), 1) - 1 AS ret FROM (
  SELECT arm, fold_id, date, 1 + sum(weight * (g - 1)) AS v FROM grown GROUP BY ALL)""")
view("drifted", "SELECT arm, fold_id, date, instrument, weight * g / (1 + sum(weight * (g - 1)) OVER (PARTITION BY arm, fold_id, date)) AS weight FROM grown")
view("costs", f"""SELECT arm, fold_id, sum(abs(coalesce(t.weight, 0) - coalesce(d.held, 0))) AS turnover, sum(abs(coalesce(t.weight, 0) - coalesce(d.held, 0))) * {BPS} / 10000 AS cost FROM targets t
  FULL JOIN (SELECT arm, fold_id + 1 AS fold_id, instrument, arg_max(weight, date) AS held FROM drifted WHERE (arm, fold_id + 1) IN (SELECT (arm, fold_id) FROM targets) GROUP BY ALL) d USING (arm, fold_id, instrument) GROUP BY ALL""")
view("net", "SELECT arm, fold_id, date, ret - CASE WHEN row_number() OVER (PARTITION BY arm, fold_id ORDER BY date) = 1 THEN cost ELSE 0 END AS ret FROM gross JOIN costs USING (arm, fold_id)")


@shared
def targets(spark, sf):
    from pyspark.sql import Window

    mu = means(spark, sf)
    equal = mu.select("fold_id", F.lit("EQUAL").alias("arm"), "instrument", (1.0 / F.count("*").over(Window.partitionBy("fold_id"))).alias("weight"))
    bench = mu.select("fold_id").distinct().crossJoin(F.broadcast(benchmark(spark, sf))).select("fold_id", F.lit("BENCH").alias("arm"), "instrument", "weight")
    ranked = mu.withColumn("k", F.row_number().over(Window.partitionBy("fold_id").orderBy(F.desc("mu"), "instrument")))
    top = ranked.where("k = 1").select("fold_id", F.lit("TOP").alias("arm"), "instrument", F.lit(1.0).alias("weight"))
    two = ranked.where("k <= 2").select("fold_id", F.lit("TOP2").alias("arm"), "instrument", F.lit(0.5).alias("weight"))
    return equal.unionByName(bench).unionByName(top).unionByName(two)


@shared
def grown(spark, sf):
    return le.growth(targets(spark, sf), hold(spark, sf))


@shared
def costs(spark, sf):
    return le.turnover_costs(targets(spark, sf), le.drifted_weights(grown(spark, sf)), BPS)


@shared
def net(spark, sf):
    return le.net_returns(le.ledger_returns(grown(spark, sf)), costs(spark, sf))


@query("arm_targets", "SELECT fold_id, arm, instrument, round(weight, 6) AS weight FROM targets")
def arm_targets(spark, sf):
    return targets(spark, sf).withColumn("weight", F.round("weight", 6))


query("alloc_equal", "SELECT fold_id, instrument, round(weight, 6) AS weight FROM targets WHERE arm = 'EQUAL'")(lambda s, d: arm_targets(s, d).where("arm = 'EQUAL'").drop("arm"))
query("alloc_benchmark", "SELECT fold_id, instrument, round(weight, 6) AS weight FROM targets WHERE arm = 'BENCH'")(lambda s, d: arm_targets(s, d).where("arm = 'BENCH'").drop("arm"))


@query("ledger_returns", "SELECT arm, fold_id, date, round(ret, 8) + 0.0 AS ret FROM gross")
def ledger_returns(spark, sf):
    return le.ledger_returns(grown(spark, sf)).withColumn("ret", rounded(F.col("ret"), 8))


@query("drifted_weights", "SELECT arm, fold_id, date, instrument, round(weight, 8) + 0.0 AS weight FROM drifted")
def drifted_weights(spark, sf):
    return le.drifted_weights(grown(spark, sf)).withColumn("weight", rounded(F.col("weight"), 8))


@query("turnover_costs", "SELECT arm, fold_id, round(turnover, 8) + 0.0 AS turnover, round(cost, 8) + 0.0 AS cost FROM costs")
def turnover_costs(spark, sf):
    return costs(spark, sf).select("arm", "fold_id", rounded(F.col("turnover"), 8).alias("turnover"), rounded(F.col("cost"), 8).alias("cost"))


@query("net_returns", "SELECT arm, fold_id, date, round(ret, 8) + 0.0 AS ret FROM net")
def net_returns(spark, sf):
    return net(spark, sf).withColumn("ret", rounded(F.col("ret"), 8))


@query("total_costs", "SELECT arm, count(*) AS rebalances, round(sum(cost), 8) + 0.0 AS total_cost FROM costs GROUP BY 1")
def total_costs(spark, sf):
    return costs(spark, sf).groupBy("arm").agg(F.count("*").alias("rebalances"), rounded(F.sum("cost"), 8).alias("total_cost"))


FINANCING = "SELECT 'N' || n_nationkey AS node_id, n_nationkey = 0 AS is_root, 0.01 + n_regionkey * 0.005 AS risk_free, 25.0 * (n_nationkey % 4) AS spread_bps, n_nationkey % 2 = 0 AS financing FROM nation"


def financing_nodes(spark, sf):
    k = F.col("n_nationkey")
    return table(spark, sf, "nation").select(F.concat(F.lit("N"), k.cast("string")).alias("node_id"), (k == 0).alias("is_root"), (0.01 + F.col("n_regionkey") * 0.005).alias("risk_free"), (25.0 * (k % 4)).alias("spread_bps"), (k % 2 == 0).alias("financing"))


@query("financing_returns", f"""SELECT date, leg || CASE WHEN is_root THEN '' ELSE '@' || node_id END AS instrument, round((risk_free + CASE WHEN leg = 'cash:BORROW' THEN spread_bps / 10000 ELSE 0 END) / 252, 10) AS ret
  FROM ({FINANCING}) CROSS JOIN (VALUES ('cash:RF'), ('cash:BORROW')) l(leg) CROSS JOIN (SELECT DISTINCT date FROM type_valuation) WHERE financing""")
def financing_returns(spark, sf):
    return le.financing_returns(valuation(spark, sf), financing_nodes(spark, sf)).withColumn("ret", F.round("ret", 10))


view("with_cash_targets", "SELECT fold_id, arm, instrument, 0.9 * weight AS weight FROM targets WHERE arm <> 'TOP' UNION ALL SELECT DISTINCT fold_id, arm, 'cash:RF', 0.1 FROM targets WHERE arm <> 'TOP'")


def _cash_ledger(rate):
    hold_cash = f"(SELECT fold_id, date, instrument, ret FROM hold UNION ALL SELECT DISTINCT fold_id, date, 'cash:RF', {rate} FROM hold)"
    sql = f"""SELECT arm, fold_id, date, round(v / coalesce(lag(v) OVER (PARTITION BY arm, fold_id ORDER BY date), 1) - 1, 8) + 0.0 AS ret FROM (
      SELECT arm, fold_id, date, 1 + sum(weight * (g - 1)) AS v FROM (SELECT fold_id, arm, h.date, instrument, weight, product(1 + h.ret) OVER (PARTITION BY fold_id, arm, instrument ORDER BY h.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g
      FROM with_cash_targets JOIN {hold_cash} h USING (fold_id, instrument)) GROUP BY ALL)"""

    def run(spark, sf):
        t = targets(spark, sf).where("arm <> 'TOP'")
        cash = t.select("fold_id", "arm").distinct().select("fold_id", "arm", F.lit("cash:RF").alias("instrument"), F.lit(0.1).alias("weight"))
        h = hold(spark, sf)
        rows = h.unionByName(h.select("fold_id", "date").distinct().select("fold_id", "date", F.lit("cash:RF").alias("instrument"), F.lit(rate).alias("ret")))
        done = le.ledger_returns(le.growth(t.withColumn("weight", 0.9 * F.col("weight")).unionByName(cash), rows))
        return done.withColumn("ret", rounded(F.col("ret"), 8))

    return sql, run


for name, rate in (("ledger_zero_cash", 0.0), ("ledger_accruing_cash", 0.03 / 252)):
    sql, run = _cash_ledger(rate)
    query(name, sql)(run)


@query("oos_grid_gaps", "SELECT date, count(DISTINCT arm) AS arms FROM net WHERE NOT (arm = 'TOP' AND fold_id % 7 = 0) GROUP BY 1 HAVING count(DISTINCT arm) < 4")
def oos_grid_gaps(spark, sf):
    return le.grid_gaps(net(spark, sf).where("NOT (arm = 'TOP' AND fold_id % 7 = 0)"))


METRICS = ["cagr", "annualized_volatility", "annualized_excess_return", "annualized_sharpe", "annualized_sortino"]
METRIC_SQL = """SELECT {key}, product(1 + ret) ** (252.0 / count(*)) - 1 AS cagr, coalesce(stddev_samp(ret), 0) * sqrt(252.0) AS annualized_volatility, avg(ret - {rf} / 252) * 252 AS annualized_excess_return,
  CASE WHEN coalesce(stddev_samp(ret), 0) > 0 THEN avg(ret - {rf} / 252) / stddev_samp(ret) * sqrt(252.0) ELSE 0 END AS annualized_sharpe,
  CASE WHEN sqrt(avg(least(ret - {rf} / 252, 0) ** 2)) > 0 THEN avg(ret - {rf} / 252) * 252 / (sqrt(avg(least(ret - {rf} / 252, 0) ** 2)) * sqrt(252.0)) ELSE 0 END AS annualized_sortino, count(*) AS n_obs FROM {rows} GROUP BY {key}"""
ROUNDED_METRICS = ", ".join(f"round({m}, 6) + 0.0 AS {m}" for m in METRICS)
view("drawdown_rows", """SELECT arm, date, wealth, max(wealth) OVER (PARTITION BY arm ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM (
  SELECT arm, date, product(1 + ret) OVER (PARTITION BY arm ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS wealth FROM net)""")


def round_metrics(frame):
    return frame.withColumns({m: rounded(F.col(m)) for m in METRICS})


@query("performance_metrics", f"SELECT arm, {ROUNDED_METRICS}, n_obs, max_drawdown FROM ({METRIC_SQL.format(key='arm', rf='0.02', rows='net')}) JOIN (SELECT arm, round(min(wealth / peak - 1), 6) + 0.0 AS max_drawdown FROM drawdown_rows GROUP BY 1) USING (arm)")
def performance_metrics(spark, sf):
    curves = net(spark, sf)
    dd = le.max_drawdown(curves, ["arm"]).select("arm", rounded(F.col("max_drawdown")).alias("max_drawdown"))
    return round_metrics(le.metrics(curves, ["arm"], F.lit(0.02))).join(dd, "arm")


@query("drawdown_curve", "SELECT arm, date, round(wealth, 6) AS wealth, round(peak, 6) AS peak, round(wealth / peak - 1, 6) + 0.0 AS drawdown FROM drawdown_rows")
def drawdown_curve(spark, sf):
    return le.drawdowns(net(spark, sf), ["arm"]).select("arm", "date", F.round("wealth", 6).alias("wealth"), F.round("peak", 6).alias("peak"), rounded(F.col("drawdown")).alias("drawdown"))


@query("max_drawdown", "SELECT arm, round(min(wealth / peak - 1), 6) + 0.0 AS max_drawdown FROM drawdown_rows GROUP BY 1")
def max_drawdown(spark, sf):
    return le.max_drawdown(net(spark, sf), ["arm"]).select("arm", rounded(F.col("max_drawdown")).alias("max_drawdown"))


RATES = "SELECT 'NODE:' || s_suppkey AS arm, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_acctbal / 1000000 END AS own FROM supplier UNION ALL SELECT 'FINAL', NULL"


@query("arm_risk_free", f"SELECT arm, round(coalesce(own, 0.02), 6) AS risk_free_rate, CASE WHEN own IS NOT NULL THEN 'node' ELSE 'root' END AS source FROM ({RATES})")
def arm_risk_free(spark, sf):
    own = F.when(F.col("s_suppkey") % 3 != 0, F.col("s_acctbal") / 1000000)
    arms = table(spark, sf, "supplier").select(F.concat(F.lit("NODE:"), F.col("s_suppkey").cast("string")).alias("arm"), own.alias("own"))
    arms = arms.unionByName(spark.sql("SELECT 'FINAL' AS arm, CAST(NULL AS DOUBLE) AS own"))
    return arms.select("arm", F.round(F.coalesce("own", F.lit(0.02)), 6).alias("risk_free_rate"), F.when(F.col("own").isNotNull(), "node").otherwise("root").alias("source"))


def accumulated_sql(op):
    rows = f"(SELECT arm, signal, date, ret FROM net JOIN (SELECT DISTINCT signal FROM folds_r) ON date {op} signal)"
    dd = f"""SELECT arm, signal, min(wealth / peak - 1) AS max_drawdown FROM (SELECT *, max(wealth) OVER (PARTITION BY arm, signal ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM (
      SELECT *, product(1 + ret) OVER (PARTITION BY arm, signal ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS wealth FROM {rows})) GROUP BY ALL"""
    return f"SELECT * FROM ({METRIC_SQL.format(key='arm, signal', rf='0.0', rows=rows)}) JOIN ({dd}) USING (arm, signal)"


view("accumulated", accumulated_sql("<"))
view("accumulated_to", accumulated_sql("<="))


@query("accumulated_metrics", f"SELECT arm, signal, {ROUNDED_METRICS}, n_obs, round(max_drawdown, 6) + 0.0 AS max_drawdown FROM accumulated")
def accumulated_metrics(spark, sf):
    done = le.metrics_before(net(spark, sf), rolling(spark, sf))
    return round_metrics(done).withColumn("max_drawdown", rounded(F.col("max_drawdown")))


@query("node_value_comparison", f"""SELECT year, max(CASE WHEN arm = 'EQUAL' THEN s END) AS equal_sharpe, max(CASE WHEN arm = 'BENCH' THEN s END) AS bench_sharpe, max(CASE WHEN arm = 'TOP2' THEN s END) AS top2_sharpe FROM (
  SELECT year, arm, round(annualized_sharpe, 6) + 0.0 AS s FROM ({METRIC_SQL.format(key='arm, year', rf='0.0', rows='(SELECT *, year(date) AS year FROM net)')})) GROUP BY 1""")
def node_value_comparison(spark, sf):
    done = round_metrics(le.metrics(net(spark, sf).withColumn("year", F.year("date")), ["arm", "year"]))
    wide = done.groupBy("year").pivot("arm", ["EQUAL", "BENCH", "TOP2"]).agg(F.max("annualized_sharpe"))
    return wide.select("year", F.col("EQUAL").alias("equal_sharpe"), F.col("BENCH").alias("bench_sharpe"), F.col("TOP2").alias("top2_sharpe"))


@query("compressed_curve", """SELECT arm, max(date) AS date, round(product(1 + ret) - 1, 6) + 0.0 AS ret FROM (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY date) - 1 AS k, CAST(ceil(count(*) OVER (PARTITION BY arm) / 600) AS BIGINT) AS step FROM net) GROUP BY arm, k // step""")
def compressed_curve(spark, sf):
    return le.compress(net(spark, sf)).withColumn("ret", rounded(F.col("ret")))


@query("weight_history", """SELECT g.arm, g.fold_id, e.instrument, round(coalesce(t.weight, 0), 6) + 0.0 AS weight FROM (SELECT DISTINCT arm, fold_id FROM targets) g JOIN (SELECT arm, instrument FROM targets GROUP BY ALL HAVING max(abs(weight)) > 0) e USING (arm)
  LEFT JOIN targets t ON t.arm = g.arm AND t.fold_id = g.fold_id AND t.instrument = e.instrument""")
def weight_history(spark, sf):
    return le.weight_history(targets(spark, sf)).withColumn("weight", rounded(F.col("weight")))


@query("export_curves_long", "SELECT arm, year(date) AS year, date, round(ret, 8) + 0.0 AS ret FROM net")
def export_curves_long(spark, sf):
    return net(spark, sf).select("arm", F.year("date").alias("year"), "date", rounded(F.col("ret"), 8).alias("ret"))


@query("export_weights_long", "SELECT arm, fold_id, signal, instrument, round(weight, 6) AS weight FROM targets JOIN folds_r USING (fold_id)")
def export_weights_long(spark, sf):
    return targets(spark, sf).join(rolling(spark, sf).select("fold_id", "signal"), "fold_id").select("arm", "fold_id", "signal", "instrument", F.round("weight", 6).alias("weight"))


@query("export_manifest")
def export_manifest(spark, sf):
    def one(name, frame):
        return frame.agg(F.lit(name).alias("table"), F.count("*").alias("n_rows"), F.sum(F.xxhash64(*frame.columns).cast("decimal(38,0)")).alias("checksum"))

    return one("curves", export_curves_long(spark, sf)).union(one("weights", export_weights_long(spark, sf))).union(one("costs", turnover_costs(spark, sf)))


@query("backtest_violations", """SELECT arm, fold_id, 'weights do not sum to one' AS problem FROM targets GROUP BY ALL HAVING abs(sum(weight) - 1) > 5e-5
  UNION ALL SELECT arm, fold_id, 'weight above cap' FROM targets WHERE weight > 0.6 UNION ALL SELECT arm, fold_id, 'cost above limit' FROM costs WHERE cost > 0.0015""")
def backtest_violations(spark, sf):
    t = targets(spark, sf)
    total = t.groupBy("arm", "fold_id").agg(F.sum("weight").alias("s")).where("abs(s - 1) > 5e-5").select("arm", "fold_id", F.lit("weights do not sum to one").alias("problem"))
    cap = t.where("weight > 0.6").select("arm", "fold_id", F.lit("weight above cap").alias("problem"))
    return total.unionByName(cap).unionByName(costs(spark, sf).where("cost > 0.0015").select("arm", "fold_id", F.lit("cost above limit").alias("problem")))


@query("written_export", "SELECT 'curves' AS name, count(*) AS n_rows, true AS verified FROM net UNION ALL SELECT 'weights', count(*), true FROM targets UNION ALL SELECT 'costs', count(*), true FROM costs")
def written_export(spark, sf):
    """Curves by arm and year, weights by arm and signal and costs, written under a manifest and read back."""
    path = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    tables = {"curves": (export_curves_long(spark, sf), ["arm", "year"]), "weights": (export_weights_long(spark, sf), ["arm", "signal"]), "costs": (turnover_costs(spark, sf), [])}
    ex.write_export(tables, path)
    return ex.verify_export(spark, path).select("name", "n_rows", "verified")


@query("recurrence_returns", "SELECT arm, fold_id, date, round(ret, 8) + 0.0 AS ret FROM gross")
def recurrence_returns(spark, sf):
    return le.recurrence_returns(targets(spark, sf), hold(spark, sf)).withColumn("ret", rounded(F.col("ret"), 8))


@query("reconciliation_violations", "SELECT arm, fold_id, 'returns differ' AS problem FROM gross WHERE arm = 'TOP' AND fold_id % 7 = 3 GROUP BY 1, 2")
def reconciliation_violations(spark, sf):
    """Folds of which a curve differs from the recurrence; every seventh fold of one arm is shifted here to make cases."""
    shifted = (F.col("arm") == "TOP") & (F.col("fold_id") % 7 == 3)
    curves = le.ledger_returns(grown(spark, sf)).withColumn("ret", F.col("ret") + F.when(shifted, 1e-4).otherwise(0.0))
    return le.reconciled(curves, targets(spark, sf), hold(spark, sf))


# Pruning evidence: each year is a node, BENCH its own arm and EQUAL its father, under two protocols

view("evidence", """SELECT protocol, node_id, CASE arm WHEN 'TOP2' THEN 'NODE' ELSE 'FATHER' END AS side, annualized_sharpe AS sharpe, max_drawdown, annualized_volatility AS volatility FROM (
    SELECT 'rolling' AS protocol, strftime(signal, '%Y-%m-%d') AS node_id, * EXCLUDE (signal) FROM accumulated UNION ALL SELECT 'expanding', strftime(signal, '%Y-%m-%d'), * EXCLUDE (signal) FROM accumulated_to WHERE month(signal) <> 3) WHERE arm IN ('TOP2', 'EQUAL')""")
view("observed", """SELECT node_id, protocol, n.sharpe - f.sharpe AS sharpe_delta, n.ratio AS node_ratio, f.ratio AS father_ratio, coalesce(n.sharpe - f.sharpe >= 0.03 AND n.ratio <= f.ratio * 1.1, false) AS passed
  FROM (SELECT strftime(signal, '%Y-%m-%d') AS node_id, protocol FROM folds_r CROSS JOIN (VALUES ('rolling'), ('expanding')) p(protocol))
  LEFT JOIN (SELECT protocol, node_id, sharpe, CASE WHEN volatility > 0 THEN abs(max_drawdown) / volatility ELSE 'infinity'::DOUBLE END AS ratio FROM evidence WHERE side = 'NODE') n USING (protocol, node_id)
  LEFT JOIN (SELECT protocol, node_id, sharpe, CASE WHEN volatility > 0 THEN abs(max_drawdown) / volatility ELSE 'infinity'::DOUBLE END AS ratio FROM evidence WHERE side = 'FATHER') f USING (protocol, node_id)""")
view("decided", """SELECT node_id, CASE WHEN bool_and(passed) THEN 'retain' ELSE 'prune' END AS decision,
  CASE WHEN bool_and(passed) THEN 'passes every protocol' ELSE coalesce(string_agg(CASE WHEN sharpe_delta IS NULL THEN protocol || ': missing' WHEN NOT passed THEN protocol || ': failed' END, '; ' ORDER BY protocol), '') END AS reason FROM observed GROUP BY 1""")


@shared
def evidence(spark, sf):
    def one(protocol, inclusive):
        done = le.metrics_before(net(spark, sf).where("arm IN ('TOP2', 'EQUAL')"), rolling(spark, sf), inclusive)
        side = F.when(F.col("arm") == "TOP2", "NODE").otherwise("FATHER")
        return done.select(F.lit(protocol).alias("protocol"), F.date_format("signal", "yyyy-MM-dd").alias("node_id"), side.alias("side"), F.col("annualized_sharpe").alias("sharpe"), "max_drawdown", F.col("annualized_volatility").alias("volatility"), "signal")

    return one("rolling", False).unionByName(one("expanding", True).where("month(signal) <> 3")).drop("signal")


def observed(spark, sf):
    nodes = rolling(spark, sf).select(F.date_format("signal", "yyyy-MM-dd").alias("node_id"))
    return pru.observations(nodes, evidence(spark, sf), ["rolling", "expanding"])


@query("prune_observations", "SELECT node_id, protocol, round(sharpe_delta, 6) + 0.0 AS sharpe_delta, round(node_ratio, 6) + 0.0 AS node_ratio, round(father_ratio, 6) + 0.0 AS father_ratio, passed FROM observed")
def prune_observations(spark, sf):
    return observed(spark, sf).withColumns({c: rounded(F.col(c)) for c in ("sharpe_delta", "node_ratio", "father_ratio")})


@query("prune_decisions", "SELECT * FROM decided")
def prune_decisions(spark, sf):
    return pru.decisions(observed(spark, sf))


@query("burn_in_cutoff", "SELECT DISTINCT CAST(min(holding_start) OVER () + INTERVAL 2 YEAR AS DATE) AS calendar_cutoff, CAST(min(holding_start) OVER () + CAST(floor(1.5 * 365.2425) AS INTEGER) AS DATE) AS fractional_cutoff FROM folds_r")
def burn_in_cutoff(spark, sf):
    first = F.min("holding_start")
    return rolling(spark, sf).agg(years_after(first, 2).alias("calendar_cutoff"), years_after(first, 1.5).alias("fractional_cutoff"))


@query("last_folds", "SELECT fold_id, signal FROM folds_r ORDER BY fold_id DESC LIMIT 13")
def last_folds(spark, sf):
    return rolling(spark, sf).select("fold_id", "signal").orderBy(F.desc("fold_id")).limit(13)


@query("target_l1_distance", """SELECT fold_id, round(sum(abs(coalesce(a.weight, 0) - coalesce(b.weight, 0))), 6) + 0.0 AS distance FROM (SELECT * FROM targets WHERE arm = 'TOP2') a
  FULL JOIN (SELECT * FROM targets WHERE arm = 'BENCH') b USING (fold_id, instrument) GROUP BY 1""")
def target_l1_distance(spark, sf):
    from arborfolio.operators.moments import weight_delta

    t = targets(spark, sf)
    delta = weight_delta(t.where("arm = 'TOP2'").drop("arm"), t.where("arm = 'BENCH'").drop("arm"), ["fold_id"])
    return delta.groupBy("fold_id").agg(rounded(F.sum(F.abs("delta"))).alias("distance"))


ADAPTIVE = """SELECT fold_id, t.instrument, round(t.weight, 6) AS weight, d.decision FROM folds_r f JOIN decided d ON strftime(f.signal, '%Y-%m-%d') = d.node_id
  JOIN targets t USING (fold_id) WHERE t.arm = CASE WHEN f.holding_start >= (SELECT CAST(min(holding_start) + INTERVAL 2 YEAR AS DATE) FROM folds_r) AND d.decision = 'prune' THEN 'EQUAL' ELSE 'TOP2' END"""


@query("adaptive_targets", ADAPTIVE)
def adaptive_targets(spark, sf):
    """After the burn-in a pruned fold takes its father's target; before it, and when retained, its own."""
    f = rolling(spark, sf)
    start = f.agg(years_after(F.min("holding_start"), 2).alias("cutoff"))
    decided = pru.decisions(observed(spark, sf)).select(F.col("node_id").alias("day"), "decision")
    chosen = f.crossJoin(F.broadcast(start)).join(decided, F.date_format("signal", "yyyy-MM-dd") == F.col("day"))
    arm = F.when((F.col("holding_start") >= F.col("cutoff")) & (F.col("decision") == "prune"), "EQUAL").otherwise("TOP2")
    return chosen.select("fold_id", "decision", arm.alias("arm")).join(targets(spark, sf), ["fold_id", "arm"]).select("fold_id", "instrument", F.round("weight", 6).alias("weight"), "decision")


view("fold_decisions", "SELECT year(CAST(node_id AS DATE)) AS fold_id, month(CAST(node_id AS DATE)) AS node_id, decision FROM decided")


def fold_decisions(spark, sf):
    day = F.to_date("node_id")
    return pru.decisions(observed(spark, sf)).select(F.year(day).alias("fold_id"), F.month(day).alias("node_id"), "decision")


@query("prune_summary", "SELECT fold_id, count(*) FILTER (decision = 'retain') AS retained, count(*) FILTER (decision = 'prune') AS pruned FROM fold_decisions GROUP BY 1")
def prune_summary(spark, sf):
    return pru.summary(fold_decisions(spark, sf))


@query("prune_rate", "SELECT node_id, round(avg(CASE WHEN decision = 'prune' THEN 1.0 ELSE 0 END), 6) AS prune_rate, count(*) AS folds FROM fold_decisions GROUP BY 1")
def prune_rate(spark, sf):
    return pru.prune_rate(fold_decisions(spark, sf)).withColumn("prune_rate", F.round("prune_rate", 6))


@query("global_guard", """SELECT candidate, bool_and(coalesce(cs >= bs AND cr <= br * 1.1, false)) AS accepted FROM (SELECT node_id AS candidate, protocol, max(CASE WHEN side = 'NODE' THEN sharpe END) AS cs, max(CASE WHEN side = 'FATHER' THEN sharpe END) AS bs,
  max(CASE WHEN side = 'NODE' THEN CASE WHEN volatility > 0 THEN abs(max_drawdown) / volatility ELSE 'infinity'::DOUBLE END END) AS cr, max(CASE WHEN side = 'FATHER' THEN CASE WHEN volatility > 0 THEN abs(max_drawdown) / volatility ELSE 'infinity'::DOUBLE END END) AS br FROM evidence GROUP BY ALL) GROUP BY 1""")
def global_guard(spark, sf):
    side = F.when(F.col("side") == "NODE", "CANDIDATE").otherwise("BASE")
    return pru.global_guard(evidence(spark, sf).withColumnRenamed("node_id", "candidate").withColumn("side", side))


@query("profile_selection", "SELECT 'ROOT' AS node_id, signal, arm AS profile FROM (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY annualized_sharpe DESC, arm) AS k FROM accumulated_to) WHERE k = 1")
def profile_selection(spark, sf):
    done = le.metrics_before(net(spark, sf), rolling(spark, sf), inclusive=True)
    return pru.select_profiles(done.select(F.lit("ROOT").alias("node_id"), "signal", F.col("arm").alias("profile"), F.col("annualized_sharpe").alias("sharpe")))


# Inference

view("paired", "SELECT c.arm, c.date, c.ret AS c, b.ret AS b, c.ret - b.ret AS diff FROM net c JOIN net b USING (date) WHERE b.arm = 'EQUAL' AND c.arm <> 'EQUAL'")


def paired(spark, sf, curves=None):
    curves = net(spark, sf) if curves is None else curves
    base = curves.where("arm = 'EQUAL'").select("date", F.col("ret").alias("b"))
    return curves.where("arm <> 'EQUAL'").join(base, "date").select("arm", "date", F.col("ret").alias("c"), "b", (F.col("ret") - F.col("b")).alias("diff"))


@query("paired_mean_difference", "SELECT arm, count(*) AS n, round(avg(diff) * 252, 6) + 0.0 AS mean_diff FROM paired GROUP BY 1")
def paired_mean_difference(spark, sf):
    return paired(spark, sf).groupBy("arm").agg(F.count("*").alias("n"), rounded(F.avg("diff") * 252).alias("mean_diff"))


@query("paired_difference_resampled", """WITH m AS (SELECT arm, last_day(date) AS date, product(1 + ret) - 1 AS ret FROM net GROUP BY ALL)
SELECT c.arm, count(*) AS n, round(avg(c.ret - b.ret) * 12, 6) + 0.0 AS mean_diff FROM m c JOIN m b USING (date) WHERE b.arm = 'EQUAL' AND c.arm <> 'EQUAL' GROUP BY 1""")
def paired_difference_resampled(spark, sf):
    monthly = le.resample_curves(net(spark, sf), "M")
    return paired(spark, sf, monthly).groupBy("arm").agg(F.count("*").alias("n"), rounded(F.avg("diff") * 12).alias("mean_diff"))


SAMPLES = inf.SAMPLES
BOOT = f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY date) - 1 AS k, count(*) OVER (PARTITION BY arm) AS n FROM paired),
sized AS (SELECT DISTINCT arm, n, CAST(ceil(n / {inf.BLOCK}) AS BIGINT) AS blocks FROM r WHERE n > {inf.BLOCK}),
starts AS (SELECT arm, n, sample, block, ('0x' || substr(md5('{inf.SEED}|' || sample || '|' || block), 1, 8))::BIGINT % n AS start FROM sized, range({SAMPLES}) s(sample), LATERAL (SELECT unnest(range(blocks)) AS block)),
idx AS (SELECT arm, sample, (start + o) % n AS k FROM starts, range({inf.BLOCK}) q(o) WHERE block * {inf.BLOCK} + o < n),
draws AS (SELECT arm, sample, avg(diff) * 252 AS m, (avg(c) / stddev_samp(c) - avg(b) / stddev_samp(b)) * sqrt(252.0) AS s FROM idx JOIN r USING (arm, k) GROUP BY ALL),
point AS (SELECT arm, count(*) AS n, avg(diff) * 252 AS mean_diff, (avg(c) / stddev_samp(c) - avg(b) / stddev_samp(b)) * sqrt(252.0) AS sharpe_diff FROM r GROUP BY 1),
found AS (SELECT arm, quantile_cont(m, 0.025) AS mean_lo, quantile_cont(m, 0.975) AS mean_hi, (1 + count(*) FILTER (abs(m - mean_diff) >= abs(mean_diff))) / ({SAMPLES} + 1) AS mean_p,
  quantile_cont(s, 0.025) AS sharpe_lo, quantile_cont(s, 0.975) AS sharpe_hi, least(1.0, 2 * least(avg(CASE WHEN s <= 0 THEN 1.0 ELSE 0 END), avg(CASE WHEN s >= 0 THEN 1.0 ELSE 0 END))) AS sharpe_p FROM draws JOIN point USING (arm) GROUP BY 1)
"""


def _boot(names):
    return BOOT + "SELECT arm, n, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in names) + f", CASE WHEN n <= {inf.BLOCK} THEN 'too few observations' END AS note FROM point LEFT JOIN found USING (arm)"


MEAN, SHARPE = ["mean_diff", "mean_lo", "mean_hi", "mean_p"], ["sharpe_diff", "sharpe_lo", "sharpe_hi", "sharpe_p"]


def _tested(rows, names):
    return inf.bootstrap(rows, ["arm"], SAMPLES).select("arm", "n", *(rounded(F.col(c)).alias(c) for c in names), "note")


query("bootstrap_mean_ci", _boot(MEAN))(lambda s, d: _tested(paired(s, d), MEAN))
query("bootstrap_sharpe_ci", _boot(SHARPE))(lambda s, d: _tested(paired(s, d), SHARPE))
query("bootstrap_small_sample", _boot(MEAN + SHARPE).replace("FROM paired)", "FROM (SELECT * FROM paired QUALIFY row_number() OVER (PARTITION BY arm ORDER BY date) <= CASE arm WHEN 'TOP' THEN 20 ELSE 60 END))"))(
    lambda s, d: _tested(_first_days(paired(s, d)), MEAN + SHARPE)
)


def _first_days(rows):
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("arm").orderBy("date"))
    return rows.withColumn("k", k).where(F.col("k") <= F.when(F.col("arm") == "TOP", 20).otherwise(60)).drop("k")


TESTS = "SELECT s_suppkey AS test, CASE WHEN s_suppkey % 10 = 3 THEN NULL ELSE round(abs(s_acctbal) / 100000, 6) END AS p FROM supplier"


@query("holm_adjust", f"""WITH t AS ({TESTS}), k AS (SELECT *, row_number() OVER (ORDER BY p, test) AS rank, count(*) OVER () AS m FROM t WHERE p IS NOT NULL)
SELECT test, p, round(max(least(1.0, (m - rank + 1) * p)) OVER (ORDER BY p, test ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS adjusted FROM k UNION ALL SELECT test, p, NULL FROM t WHERE p IS NULL""")
def holm_adjust(spark, sf):
    tests = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("test"), F.when(F.col("s_suppkey") % 10 != 3, F.round(F.abs("s_acctbal") / 100000, 6)).alias("p"))
    return inf.holm(tests).withColumn("adjusted", F.round("adjusted", 6))
