"""Queries on evidence windows, fold by fold contraction and the adaptive walk-forward."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborfolio.functions.periods import rounded
from arborfolio.operators import adaptive as ad
from arborfolio.operators import ledger as le
from arborfolio.operators.moments import weight_delta
from arborfolio.operators.pruning import MAX_RATIO, MIN_SHARPE_GAIN, select_profiles
from arborfolio.plans.allocation_queries import fill_sql
from arborfolio.plans.ledger_queries import METRIC_SQL, ROUNDED_METRICS, net, round_metrics
from arborfolio.plans.panel_queries import hold, rolling, train
from arborfolio.plans.registry import query, view
from arborfolio.plans.tree_queries import FROM_BELOW, HI, LO, slots, tree_arms, tree_curves
from arborfolio.sources.written import shared

#: Years of evidence before a signal, and of the burn-in, that the queries take.
EVIDENCE, BURN_IN = 2, 1


def window_sql(curves: str, start: str, op: str = "<") -> str:
    rows = f"(SELECT arm, signal, date, ret FROM {curves} JOIN (SELECT DISTINCT signal FROM folds_r) ON date {op} signal AND date >= {start})"
    fall = f"""SELECT arm, signal, min(wealth / peak - 1) AS max_drawdown FROM (SELECT *, max(wealth) OVER (PARTITION BY arm, signal ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM (
      SELECT *, product(1 + ret) OVER (PARTITION BY arm, signal ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS wealth FROM {rows})) GROUP BY ALL"""
    return f"SELECT * FROM ({METRIC_SQL.format(key='arm, signal', rf='0.0', rows=rows)}) JOIN ({fall}) USING (arm, signal)"


view("node_curves", """SELECT arm, date, ret FROM tree_curves JOIN (SELECT substr(arm, instr(arm, ':') + 1) AS name, date FROM tree_curves WHERE starts_with(arm, 'NODE:') OR starts_with(arm, 'FATHER:')
  GROUP BY ALL HAVING count(DISTINCT substr(arm, 1, 4)) = 2) c USING (date) WHERE arm IN ('NODE:' || name, 'FATHER:' || name)""")
view("node_windows", window_sql("node_curves", f"signal - INTERVAL {EVIDENCE} YEAR"))
view("net_windows", window_sql("net", "signal - INTERVAL 1 YEAR", "<="))


@shared
def node_windows(spark, sf):
    return ad.window_metrics(ad.common_dates(tree_curves(spark, sf)), rolling(spark, sf), EVIDENCE)


@query("windowed_node_metrics", f"SELECT arm, signal, {ROUNDED_METRICS}, n_obs, round(max_drawdown, 6) + 0.0 AS max_drawdown FROM node_windows")
def windowed_node_metrics(spark, sf):
    return round_metrics(node_windows(spark, sf)).withColumn("max_drawdown", rounded(F.col("max_drawdown")))


@query("windowed_profile_selection", "SELECT 'ROOT' AS node_id, signal, arm AS profile FROM (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY round(annualized_sharpe, 9) DESC, arm) AS k FROM net_windows) WHERE k = 1")
def windowed_profile_selection(spark, sf):
    done = ad.window_metrics(net(spark, sf), rolling(spark, sf), 1, inclusive=True)
    return select_profiles(done.select(F.lit("ROOT").alias("node_id"), "signal", F.col("arm").alias("profile"), F.round("annualized_sharpe", 9).alias("sharpe")))


@query("node_value_table", """WITH s AS (SELECT arm, count(*) AS days, avg(ret) / stddev_samp(ret) * sqrt(252.0) AS sharpe FROM tree_curves GROUP BY 1)
SELECT substr(n.arm, 6) AS node_id, n.days, round(f.sharpe, 6) + 0.0 AS proxy_sharpe, round(w.sharpe, 6) + 0.0 AS forward_sharpe, round(n.sharpe, 6) + 0.0 AS final_sharpe
FROM s n JOIN s f ON f.arm = 'FATHER:' || substr(n.arm, 6) JOIN s w ON w.arm = 'FORWARD_NODE:' || substr(n.arm, 6) WHERE starts_with(n.arm, 'NODE:')""")
def node_value_table(spark, sf):
    """Each node's final and forward portfolio against its proxy alone."""
    kind, name = F.substring_index("arm", ":", 1), F.expr("substr(arm, instr(arm, ':') + 1)")
    rows = tree_curves(spark, sf).where("instr(arm, ':') > 0").groupBy(name.alias("node_id"), kind.alias("kind"))
    done = rows.agg(F.count("*").alias("days"), rounded(F.try_divide(F.avg("ret"), F.stddev_samp("ret")) * F.sqrt(F.lit(252.0))).alias("sharpe"))
    of = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
    wide = done.groupBy("node_id").agg(of("NODE", "days").alias("days"), of("FATHER", "sharpe").alias("proxy_sharpe"), of("FORWARD_NODE", "sharpe").alias("forward_sharpe"), of("NODE", "sharpe").alias("final_sharpe"))
    return wide.where("proxy_sharpe IS NOT NULL")


# Decisions and the tree of every fold

view("fold_verdicts", f"""SELECT f.fold_id, x.node_id, CASE WHEN coalesce(n.annualized_sharpe - a.annualized_sharpe >= {MIN_SHARPE_GAIN}
    AND CASE WHEN n.annualized_volatility > 0 THEN abs(n.max_drawdown) / n.annualized_volatility ELSE 'infinity'::DOUBLE END <= {MAX_RATIO} * CASE WHEN a.annualized_volatility > 0 THEN abs(a.max_drawdown) / a.annualized_volatility ELSE 'infinity'::DOUBLE END, false) THEN 'retain' ELSE 'prune' END AS decision
  FROM folds_r f CROSS JOIN (SELECT DISTINCT child_id AS node_id FROM slots WHERE child_id IS NOT NULL) x
  LEFT JOIN node_windows n ON n.signal = f.signal AND n.arm = 'NODE:' || x.node_id LEFT JOIN node_windows a ON a.signal = f.signal AND a.arm = 'FATHER:' || x.node_id""")
view("late_folds", f"SELECT fold_id FROM folds_r WHERE signal >= (SELECT CAST(min(holding_start) + INTERVAL {BURN_IN} YEAR AS DATE) FROM folds_r)")
view("level1", "SELECT v.fold_id, v.node_id, 'ROOT' AS old_parent, CASE WHEN v.decision = 'prune' THEN 'contracted' ELSE 'kept' END AS action, CASE WHEN v.decision = 'retain' THEN 'ROOT' END AS new_parent FROM fold_verdicts v JOIN late_folds USING (fold_id) WHERE node_id IN ('CORE', 'GROWTH')")
view("level2", """SELECT v.fold_id, v.node_id, 'CORE' AS old_parent, CASE WHEN p.action = 'kept' THEN CASE WHEN v.decision = 'prune' THEN 'contracted' ELSE 'kept' END WHEN v.decision = 'prune' THEN 'removed_with_ancestor' ELSE 'lifted' END AS action,
  CASE WHEN v.decision = 'retain' THEN CASE WHEN p.action = 'kept' THEN 'CORE' ELSE 'ROOT' END END AS new_parent FROM fold_verdicts v JOIN level1 p ON p.fold_id = v.fold_id AND p.node_id = 'CORE' WHERE v.node_id = 'SIZES'""")
view("fold_actions", "SELECT * FROM level1 UNION ALL SELECT * FROM level2")
view("fold_slots", f"""SELECT fold_id, node_id, instrument, child_id, {LO} AS lo, {HI} AS hi FROM (SELECT *, row_number() OVER (PARTITION BY fold_id, node_id, instrument ORDER BY r, turn) AS k FROM (
  SELECT l.fold_id, s.node_id, s.instrument, s.child_id, 1 AS r, '' AS turn FROM slots s CROSS JOIN late_folds l LEFT JOIN fold_actions a ON a.fold_id = l.fold_id AND a.node_id = s.node_id WHERE s.child_id IS NULL AND (s.node_id = 'ROOT' OR a.action IN ('kept', 'lifted'))
  UNION ALL SELECT a.fold_id, a.new_parent, s.instrument, s.child_id, 0, s.child_id FROM slots s JOIN fold_actions a ON a.node_id = s.child_id WHERE a.action IN ('kept', 'lifted')
  UNION ALL SELECT a.fold_id, s.node_id, s.instrument, NULL, 2, s.child_id FROM slots s JOIN fold_actions a ON a.node_id = s.child_id WHERE a.action = 'contracted')) WHERE k = 1""")


@shared
def decided(spark, sf):
    nodes = slots(spark)[0].where("child_id IS NOT NULL").select(F.col("child_id").alias("node_id"))
    return ad.fold_decisions(tree_curves(spark, sf), rolling(spark, sf), nodes, EVIDENCE)


def late(spark, sf):
    from arborfolio.functions.periods import years_after

    f = rolling(spark, sf)
    return f.join(f.agg(years_after(F.min("holding_start"), BURN_IN).alias("cutoff"))).where("signal >= cutoff").select("fold_id")


@query("fold_node_decisions", "SELECT fold_id, node_id, decision FROM fold_verdicts")
def fold_node_decisions(spark, sf):
    return decided(spark, sf).select("fold_id", "node_id", "decision")


@query("fold_prune_actions", "SELECT fold_id, node_id, action, new_parent FROM fold_actions")
def fold_prune_actions(spark, sf):
    return ad.fold_trees(slots(spark)[0], decided(spark, sf).join(late(spark, sf), "fold_id", "left_semi"))[0]


@query("contracted_slots", "SELECT fold_id, node_id, instrument, child_id, lo, hi FROM fold_slots")
def contracted_slots(spark, sf):
    return ad.fold_trees(slots(spark)[0], decided(spark, sf).join(late(spark, sf), "fold_id", "left_semi"))[1]


# The adaptive run: each late fold's own tree, forward and backward

view("af_w", fill_sql("(SELECT fold_id, node_id, instrument, child_id, mu, lo, hi FROM fold_slots JOIN mu_e USING (fold_id, instrument))", "fold_id, node_id", "mu DESC, instrument"))
view("af_leaf", "SELECT fold_id, node_id, instrument, child_id, weight FROM af_w WHERE (fold_id, node_id) NOT IN (SELECT (fold_id, node_id) FROM fold_slots WHERE child_id IS NOT NULL)")
view("ab2", "SELECT * FROM af_leaf WHERE node_id = 'SIZES'")
view("ab2_s", "SELECT fold_id, node_id, date, sum(weight * ret) AS ret FROM ab2 JOIN train USING (fold_id, instrument) GROUP BY ALL")


def rows_sql(nodes: str, below: str) -> str:
    return f"""SELECT s.fold_id, s.node_id, s.instrument, s.child_id, t.date, t.ret FROM fold_slots s JOIN train t USING (fold_id, instrument) WHERE s.child_id IS NULL AND s.node_id IN ({nodes})
  UNION ALL SELECT s.fold_id, s.node_id, s.instrument || '_SYNTH', s.child_id, b.date, b.ret FROM fold_slots s JOIN ({below}) b ON b.fold_id = s.fold_id AND b.node_id = s.child_id WHERE s.node_id IN ({nodes})"""


def level_sql(rows: str, nodes: str) -> str:
    inner = FROM_BELOW + fill_sql(f"(SELECT fold_id, node_id, instrument, child_id, avg(ret) AS mu, {LO} AS lo, {HI} AS hi FROM {rows} GROUP BY ALL)", "fold_id, node_id", "mu DESC, instrument") + ")"
    return f"SELECT * FROM ({inner}) WHERE (fold_id, node_id) IN (SELECT (fold_id, node_id) FROM fold_slots WHERE child_id IS NOT NULL) UNION ALL SELECT * FROM af_leaf WHERE node_id IN ({nodes})"


view("ab1_rows", rows_sql("'CORE', 'GROWTH'", "SELECT * FROM ab2_s"))
view("ab1", level_sql("ab1_rows", "'CORE', 'GROWTH'"))
view("ab1_s", "SELECT fold_id, node_id, date, sum(weight * ret) AS ret FROM ab1 JOIN ab1_rows USING (fold_id, node_id, instrument) GROUP BY ALL")
view("ab0_rows", rows_sql("'ROOT'", "SELECT * FROM ab2_s UNION ALL SELECT * FROM ab1_s"))
view("ab0", level_sql("ab0_rows", "'ROOT'"))
view("ab_w", "SELECT * FROM ab2 UNION ALL SELECT * FROM ab1 UNION ALL SELECT * FROM ab0")
for way in ("af", "ab"):
    view(f"{way}_share", f"SELECT DISTINCT fold_id, 'ROOT' AS node_id, CAST(1.0 AS DOUBLE) AS weight FROM {way}_w UNION ALL SELECT s.fold_id, w.child_id, s.weight * w.weight FROM {way}_share s JOIN {way}_w w ON w.fold_id = s.fold_id AND w.node_id = s.node_id AND w.child_id IS NOT NULL")
    view(f"{way}_held", f"SELECT s.fold_id, w.instrument, sum(s.weight * w.weight) AS weight FROM {way}_share s JOIN {way}_w w ON w.fold_id = s.fold_id AND w.node_id = s.node_id AND w.child_id IS NULL GROUP BY ALL HAVING abs(sum(s.weight * w.weight)) > 1e-12")
view("adaptive_w", """SELECT fold_id, 'FINAL' AS arm, instrument, weight, false AS burn_in FROM ab_held UNION ALL SELECT fold_id, 'FORWARD_FINAL', instrument, weight, false FROM af_held
  UNION ALL SELECT fold_id, arm, instrument, weight, true FROM tree_arms WHERE arm IN ('FINAL', 'FORWARD_FINAL') AND fold_id NOT IN (SELECT fold_id FROM late_folds)""")


@shared
def adaptive_weights(spark, sf):
    returns = train(spark, sf).select("fold_id", "instrument", "date", "ret")
    return ad.adaptive_run(*slots(spark), returns, rolling(spark, sf), tree_arms(spark, sf), decided(spark, sf), BURN_IN)


@query("adaptive_run_targets", "SELECT fold_id, arm, instrument, round(weight, 6) + 0.0 AS weight, burn_in FROM adaptive_w")
def adaptive_run_targets(spark, sf):
    return adaptive_weights(spark, sf).withColumn("weight", rounded(F.col("weight")))


@query("adaptive_l1_distance", """SELECT fold_id, round(sum(abs(coalesce(a.weight, 0) - coalesce(b.weight, 0))), 6) + 0.0 AS distance FROM (SELECT * FROM adaptive_w WHERE arm = 'FINAL') a FULL JOIN (SELECT * FROM tree_arms WHERE arm = 'FINAL') b USING (fold_id, instrument) GROUP BY 1""")
def adaptive_l1_distance(spark, sf):
    own = adaptive_weights(spark, sf).where("arm = 'FINAL'").select("fold_id", "instrument", "weight")
    delta = weight_delta(own, tree_arms(spark, sf).where("arm = 'FINAL'").select("fold_id", "instrument", "weight"), ["fold_id"])
    return delta.groupBy("fold_id").agg(rounded(F.sum(F.abs("delta"))).alias("distance"))


view("adaptive_both", "SELECT fold_id, arm, instrument, weight FROM adaptive_w UNION ALL SELECT fold_id, 'STATIC_FINAL', instrument, weight FROM tree_arms WHERE arm = 'FINAL'")


@query("adaptive_curves", """SELECT arm, fold_id, date, round(v / coalesce(lag(v) OVER (PARTITION BY arm, fold_id ORDER BY date), 1) - 1, 8) + 0.0 AS ret FROM (SELECT arm, fold_id, date, 1 + sum(weight * (g - 1)) AS v FROM (
  SELECT fold_id, arm, h.date, instrument, weight, product(1 + h.ret) OVER (PARTITION BY fold_id, arm, instrument ORDER BY h.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM adaptive_both JOIN hold h USING (fold_id, instrument)) GROUP BY ALL)""")
def adaptive_curves(spark, sf):
    static = tree_arms(spark, sf).where("arm = 'FINAL'").select("fold_id", F.lit("STATIC_FINAL").alias("arm"), "instrument", "weight")
    both = adaptive_weights(spark, sf).drop("burn_in").unionByName(static)
    return le.ledger_returns(le.growth(both, hold(spark, sf))).withColumn("ret", rounded(F.col("ret"), 8))
