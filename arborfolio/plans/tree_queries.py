"""Queries on allocation trees, and on pruning of the region tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborfolio.functions.periods import rounded
from arborfolio.operators import allocation as al
from arborfolio.operators import hierarchy as hi
from arborfolio.operators import ledger as le
from arborfolio.operators import moments as mo
from arborfolio.operators import pruning as pru
from arborfolio.plans.allocation_queries import best_return, fill_sql
from arborfolio.plans.ledger_queries import BPS
from arborfolio.plans.panel_queries import hold, train
from arborfolio.plans.registry import query, view
from arborfolio.plans.risk_queries import benchmark, covariances, means
from arborfolio.sources.prices import table
from arborfolio.sources.written import shared

# The wide tree: root -> regions -> nations -> suppliers, each supplier an instrument

view("edges", "SELECT 'ROOT' AS parent_id, 'R' || r_regionkey AS child_id FROM region UNION ALL SELECT 'R' || n_regionkey, 'N' || n_nationkey FROM nation UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey FROM supplier")
view("walked", "SELECT 'ROOT' AS node_id, 0 AS depth, 'ROOT' AS path UNION ALL SELECT e.child_id, w.depth + 1, w.path || '/' || e.child_id FROM walked w JOIN edges e ON e.parent_id = w.node_id")


def edges(spark, sf):
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    r = table(spark, sf, "region").select(F.lit("ROOT").alias("parent_id"), name("R", "r_regionkey").alias("child_id"))
    n = table(spark, sf, "nation").select(name("R", "n_regionkey").alias("parent_id"), name("N", "n_nationkey").alias("child_id"))
    s = table(spark, sf, "supplier").select(name("N", "s_nationkey").alias("parent_id"), name("S", "s_suppkey").alias("child_id"))
    return r.union(n).union(s)


def roots(spark):
    return spark.range(1).select(F.lit("ROOT").alias("node_id"))


@query("tree_depths", "SELECT node_id, depth, path FROM walked")
def tree_depths(spark, sf):
    return hi.walk(edges(spark, sf), roots(spark)).select("node_id", "depth", "path")


@query("subtree_terminals", """SELECT DISTINCT a.node_id, 'ticker:' || b.node_id AS instrument FROM walked a JOIN walked b ON starts_with(b.path || '/', a.path || '/') WHERE starts_with(b.node_id, 'S')""")
def subtree_terminals(spark, sf):
    held = edges(spark, sf).where("child_id LIKE 'S%'").select(F.col("child_id").alias("node_id"), F.concat(F.lit("ticker:"), "child_id").alias("instrument"))
    return hi.subtree_terminals(edges(spark, sf), held)


view("split", """SELECT 'ROOT' AS parent_id, 'R' || n_regionkey AS child_id, sum(s_acctbal + 1000) / sum(sum(s_acctbal + 1000)) OVER () AS weight FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_regionkey
  UNION ALL SELECT 'R' || n_regionkey, 'N' || n_nationkey, sum(s_acctbal + 1000) / sum(sum(s_acctbal + 1000)) OVER (PARTITION BY n_regionkey) FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_regionkey, n_nationkey""")
view("held_in", "SELECT 'N' || s_nationkey AS node_id, CASE WHEN s_suppkey % 17 = 0 THEN 'cash:RF' ELSE 'ticker:S' || s_suppkey END AS instrument, (s_acctbal + 1000) / sum(s_acctbal + 1000) OVER (PARTITION BY s_nationkey) AS weight FROM supplier")
view("shares", "SELECT 'ROOT' AS node_id, CAST(1.0 AS DOUBLE) AS weight, 0 AS d UNION ALL SELECT s.child_id, w.weight * s.weight, w.d + 1 FROM shares w JOIN split s ON s.parent_id = w.node_id")


def split(spark, sf):
    from pyspark.sql import Window

    j = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    size = F.sum(F.col("s_acctbal") + 1000).alias("w")
    region = j.groupBy(F.lit("ROOT").alias("parent_id"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("child_id")).agg(size)
    nation = j.groupBy(F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("parent_id"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("child_id")).agg(size)
    return region.union(nation).select("parent_id", "child_id", (F.col("w") / F.sum("w").over(Window.partitionBy("parent_id"))).alias("weight"))


def held_in(spark, sf):
    from pyspark.sql import Window

    s = table(spark, sf, "supplier")
    name = F.when(F.col("s_suppkey") % 17 == 0, "cash:RF").otherwise(F.concat(F.lit("ticker:S"), F.col("s_suppkey").cast("string")))
    share = (F.col("s_acctbal") + 1000) / F.sum(F.col("s_acctbal") + 1000).over(Window.partitionBy("s_nationkey"))
    return s.select(F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("node_id"), name.alias("instrument"), share.alias("weight"))


@query("terminal_weights", "SELECT instrument, round(sum(s.weight * h.weight), 8) + 0.0 AS weight FROM shares s JOIN held_in h USING (node_id) GROUP BY 1 HAVING abs(sum(s.weight * h.weight)) > 1e-12")
def terminal_weights(spark, sf):
    return hi.compose(roots(spark), split(spark, sf), held_in(spark, sf)).withColumn("weight", rounded(F.col("weight"), 8))


@query("global_exposure", """SELECT node_id, round(sum(CASE WHEN starts_with(instrument, 'cash:') THEN 0 ELSE s.weight * h.weight END), 8) + 0.0 AS risky, round(sum(CASE WHEN starts_with(instrument, 'cash:') THEN s.weight * h.weight ELSE 0 END), 8) + 0.0 AS cash,
  round(sum(s.weight * h.weight), 8) + 0.0 AS net FROM shares s JOIN held_in h USING (node_id) GROUP BY 1""")
def global_exposure(spark, sf):
    share = hi.node_weights(roots(spark), split(spark, sf)).withColumnRenamed("weight", "share")
    rows = share.join(held_in(spark, sf), "node_id").select("node_id", "instrument", (F.col("share") * F.col("weight")).alias("weight"))
    return hi.exposures(rows, ["node_id"]).withColumns({c: rounded(F.col(c), 8) for c in ("risky", "cash", "net")})


# The return tree: root -> two sleeves -> part types; a sleeve's proxy is its equal-weight series

view("sleeves", "SELECT DISTINCT CASE WHEN instrument < 'ticker:N' THEN 'CORE' ELSE 'GROWTH' END AS node_id, instrument FROM type_levels")


def sleeves(spark, sf):
    from arborfolio.sources.prices import type_levels

    return type_levels(spark, sf).select("instrument").distinct().select(F.when(F.col("instrument") < "ticker:N", "CORE").otherwise("GROWTH").alias("node_id"), "instrument")


def sleeve_edges(spark, sf):
    return sleeves(spark, sf).select(F.lit("ROOT").alias("parent_id"), F.col("node_id").alias("child_id")).distinct()


def proxies(spark, sf):
    return sleeves(spark, sf).select("node_id", F.concat(F.lit("ticker:"), "node_id").alias("proxy")).distinct()


@query("node_candidates", """SELECT node_id, instrument AS candidate, 'instrument' AS kind, 'forward' AS pass FROM sleeves UNION ALL SELECT DISTINCT 'ROOT', 'ticker:' || node_id, 'proxy', 'forward' FROM sleeves
  UNION ALL SELECT node_id, instrument, 'instrument', 'backward' FROM sleeves UNION ALL SELECT DISTINCT 'ROOT', 'ticker:' || node_id || '_SYNTH', 'synthetic', 'backward' FROM sleeves""")
def node_candidates(spark, sf):
    parts = [hi.node_candidates(sleeves(spark, sf), sleeve_edges(spark, sf), proxies(spark, sf), back).withColumn("pass", F.lit("backward" if back else "forward")) for back in (False, True)]
    return parts[0].union(parts[1])


view("top_in_sleeve", "SELECT fold_id, node_id, instrument, CASE WHEN k = 1 THEN 0.7 ELSE 0.3 END AS weight FROM (SELECT fold_id, node_id, instrument, row_number() OVER (PARTITION BY fold_id, node_id ORDER BY mu DESC, instrument) AS k FROM mu_e JOIN sleeves USING (instrument)) WHERE k <= 2")
view("synthetic", "SELECT fold_id, node_id, date, sum(weight * ret) AS ret FROM top_in_sleeve JOIN train USING (fold_id, instrument) GROUP BY ALL")
view("proxy_rows", "SELECT fold_id, node_id, date, avg(ret) AS ret FROM train JOIN sleeves USING (instrument) GROUP BY ALL")


def _top(mu, key):
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("mu"), "instrument"))
    return mu.withColumn("k", k).where("k <= 2").select(*key, "instrument", F.when(F.col("k") == 1, 0.7).otherwise(0.3).alias("weight"))


@shared
def leaf_weights(spark, sf):
    return _top(means(spark, sf).join(sleeves(spark, sf), "instrument"), ["fold_id", "node_id"])


@shared
def synthetic(spark, sf):
    return hi.node_series(leaf_weights(spark, sf), train(spark, sf), ["fold_id"])


@query("synthetic_series", "SELECT fold_id, node_id, date, round(ret, 8) + 0.0 AS ret FROM synthetic")
def synthetic_series(spark, sf):
    return synthetic(spark, sf).withColumn("ret", rounded(F.col("ret"), 8))


# The allocation tree of three levels: what each node may hold, an instrument or a child by its proxy

#: Node, instrument (a child's is its proxy), child, depth of the node.
SLOTS = [
    ("ROOT", "ticker:STANDARD", None, 0), ("ROOT", "ticker:MEDIUM", "CORE", 0), ("ROOT", "ticker:SMALL", "GROWTH", 0),
    ("CORE", "ticker:ECONOMY", None, 1), ("CORE", "ticker:LARGE", "SIZES", 1),
    ("GROWTH", "ticker:PROMO", None, 1), ("GROWTH", "ticker:SMALL", None, 1),
    ("SIZES", "ticker:LARGE", None, 2), ("SIZES", "ticker:MEDIUM", None, 2),
]
LO, HI = 0.1, 0.7

view("slots", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{i}', {'NULL' if c is None else repr(c)}, {d})" for n, i, c, d in SLOTS) + ") s(node_id, instrument, child_id, depth)")
view("fwd_w", fill_sql(f"(SELECT fold_id, node_id, instrument, child_id, mu, {LO} AS lo, {HI} AS hi FROM slots JOIN mu_e USING (instrument))", "fold_id, node_id", "mu DESC, instrument"))
FROM_BELOW = "SELECT fold_id, node_id, instrument, child_id, weight FROM ("
view("back2", "SELECT fold_id, node_id, instrument, child_id, weight FROM fwd_w WHERE node_id IN ('SIZES', 'GROWTH')")
view("back2_s", "SELECT fold_id, node_id, date, sum(weight * ret) AS ret FROM back2 JOIN train USING (fold_id, instrument) GROUP BY ALL")
view("core_rows", "SELECT fold_id, instrument, CAST(NULL AS VARCHAR) AS child_id, date, ret FROM train WHERE instrument = 'ticker:ECONOMY' UNION ALL SELECT fold_id, 'ticker:LARGE_SYNTH', 'SIZES', date, ret FROM back2_s WHERE node_id = 'SIZES'")
view("back1", FROM_BELOW + fill_sql(f"(SELECT fold_id, 'CORE' AS node_id, instrument, child_id, avg(ret) AS mu, {LO} AS lo, {HI} AS hi FROM core_rows GROUP BY ALL)", "fold_id, node_id", "mu DESC, instrument") + ")")
view("back1_s", "SELECT fold_id, date, sum(weight * ret) AS ret FROM back1 JOIN core_rows USING (fold_id, instrument) GROUP BY ALL")
view("root_rows", "SELECT fold_id, instrument, CAST(NULL AS VARCHAR) AS child_id, date, ret FROM train WHERE instrument = 'ticker:STANDARD' UNION ALL SELECT fold_id, 'ticker:MEDIUM_SYNTH', 'CORE', date, ret FROM back1_s UNION ALL SELECT fold_id, 'ticker:SMALL_SYNTH', 'GROWTH', date, ret FROM back2_s WHERE node_id = 'GROWTH'")
view("back0", FROM_BELOW + fill_sql(f"(SELECT fold_id, 'ROOT' AS node_id, instrument, child_id, avg(ret) AS mu, {LO} AS lo, {HI} AS hi FROM root_rows GROUP BY ALL)", "fold_id, node_id", "mu DESC, instrument") + ")")
view("back_w", "SELECT * FROM back2 UNION ALL SELECT * FROM back1 UNION ALL SELECT * FROM back0")
for way in ("fwd", "back"):
    view(f"{way}_share", f"SELECT DISTINCT fold_id, node_id AS top, node_id, CAST(1.0 AS DOUBLE) AS weight FROM {way}_w UNION ALL SELECT s.fold_id, s.top, w.child_id, s.weight * w.weight FROM {way}_share s JOIN {way}_w w ON w.fold_id = s.fold_id AND w.node_id = s.node_id AND w.child_id IS NOT NULL")
    view(f"{way}_held", f"SELECT s.fold_id, top, instrument, sum(s.weight * w.weight) AS weight FROM {way}_share s JOIN {way}_w w ON w.fold_id = s.fold_id AND w.node_id = s.node_id AND w.child_id IS NULL GROUP BY ALL HAVING abs(sum(s.weight * w.weight)) > 1e-12")


def slots(spark):
    rows = spark.createDataFrame(SLOTS, "node_id string, instrument string, child_id string, depth int")
    return rows.drop("depth").withColumns({"lo": F.lit(LO), "hi": F.lit(HI)}), rows.select("node_id", "depth").distinct()


@shared
def forward_weights(spark, sf):
    return hi.forward_pass(slots(spark)[0], train(spark, sf).select("fold_id", "instrument", "date", "ret"))


@shared
def backward_weights(spark, sf):
    return hi.backward_pass(*slots(spark), train(spark, sf).select("fold_id", "instrument", "date", "ret"), forward=forward_weights(spark, sf))


@shared
def held_by_nodes(spark, sf, way):
    return hi.terminal_weights((forward_weights if way == "fwd" else backward_weights)(spark, sf), slots(spark)[1].select("node_id"))


def at_root(rows):
    return rows.where("top = 'ROOT'").select("fold_id", "instrument", rounded(F.col("weight")).alias("weight"))


def held_sql(way):
    return f"SELECT fold_id, instrument, round(weight, 6) + 0.0 AS weight FROM {way}_held WHERE top = 'ROOT'"


@query("node_weights_forward", "SELECT fold_id, node_id, instrument, child_id, round(weight, 6) + 0.0 AS weight FROM fwd_w")
def node_weights_forward(spark, sf):
    return forward_weights(spark, sf).withColumn("weight", rounded(F.col("weight")))


@query("node_weights_backward", "SELECT fold_id, node_id, instrument, child_id, round(weight, 6) + 0.0 AS weight FROM back_w")
def node_weights_backward(spark, sf):
    return backward_weights(spark, sf).withColumn("weight", rounded(F.col("weight")))


@query("forward_allocation", held_sql("fwd"))
def forward_allocation(spark, sf):
    return at_root(held_by_nodes(spark, sf, "fwd"))


@query("backward_allocation", held_sql("back"))
def backward_allocation(spark, sf):
    return at_root(held_by_nodes(spark, sf, "back"))


@query("bottom_up_allocation", held_sql("back"))
def bottom_up_allocation(spark, sf):
    """Leaves first and then level by level, without a forward pass; equal to the backward result, as no node looks at a forward root."""
    weights = hi.backward_pass(*slots(spark), train(spark, sf).select("fold_id", "instrument", "date", "ret"))
    return at_root(hi.terminal_weights(weights, slots(spark)[1].select("node_id")))


# The arms of a fold: benchmark, final weights, implemented benchmark, each node in both passes, each child's proxy alone

view("father", "SELECT child_id AS node_id, instrument AS proxy FROM slots WHERE child_id IS NOT NULL")
view("tree_arms", """SELECT fold_id, 'B0' AS arm, instrument, weight FROM (SELECT DISTINCT fold_id FROM back_w) CROSS JOIN bench UNION ALL SELECT fold_id, 'FINAL', instrument, weight FROM back_held WHERE top = 'ROOT'
  UNION ALL SELECT fold_id, 'NODE:' || top, instrument, weight FROM back_held UNION ALL SELECT fold_id, 'FORWARD_FINAL', instrument, weight FROM fwd_held WHERE top = 'ROOT' UNION ALL SELECT fold_id, 'FORWARD_NODE:' || top, instrument, weight FROM fwd_held
  UNION ALL SELECT fold_id, 'FATHER:' || node_id, proxy, 1.0 FROM (SELECT DISTINCT fold_id FROM back_w) CROSS JOIN father
  UNION ALL SELECT fold_id, 'B0_SYNTH', instrument, sum(weight) FROM (
    SELECT g.fold_id, coalesce(h.instrument, b.instrument) AS instrument, b.weight * coalesce(h.weight, 1) AS weight FROM (SELECT DISTINCT fold_id FROM back_w) g CROSS JOIN bench b LEFT JOIN father f ON f.proxy = b.instrument LEFT JOIN back_held h ON h.fold_id = g.fold_id AND h.top = f.node_id) GROUP BY ALL""")


@shared
def tree_arms(spark, sf):
    back, forward, bench = held_by_nodes(spark, sf, "back"), held_by_nodes(spark, sf, "fwd"), benchmark(spark, sf)
    folds = back.select("fold_id").distinct()
    father = slots(spark)[0].where("child_id IS NOT NULL").select(F.col("child_id").alias("node_id"), F.col("instrument").alias("proxy"))
    arm = lambda rows, name: rows.select("fold_id", name.alias("arm"), "instrument", "weight")
    out = arm(folds.crossJoin(F.broadcast(bench)), F.lit("B0"))  # one row an instrument
    for rows, prefix in ((back, ""), (forward, "FORWARD_")):
        out = out.unionByName(arm(rows.where("top = 'ROOT'"), F.lit(prefix + "FINAL"))).unionByName(arm(rows, F.concat(F.lit(prefix + "NODE:"), "top")))
    alone = folds.crossJoin(F.broadcast(father)).select("fold_id", F.concat(F.lit("FATHER:"), "node_id").alias("arm"), F.col("proxy").alias("instrument"), F.lit(1.0).alias("weight"))
    inner = father.join(back.withColumnRenamed("top", "node_id"), "node_id").select("fold_id", F.col("proxy").alias("held"), F.col("instrument").alias("inner"), F.col("weight").alias("share"))
    spread = folds.crossJoin(F.broadcast(bench)).withColumnRenamed("instrument", "held").join(inner, ["fold_id", "held"], "left")
    built = spread.groupBy("fold_id", F.coalesce("inner", "held").alias("instrument")).agg(F.sum(F.col("weight") * F.coalesce("share", F.lit(1.0))).alias("weight"))
    return out.unionByName(alone).unionByName(arm(built, F.lit("B0_SYNTH")))


@query("tree_arm_targets", "SELECT fold_id, arm, instrument, round(weight, 6) + 0.0 AS weight FROM tree_arms")
def tree_arm_targets(spark, sf):
    return tree_arms(spark, sf).withColumn("weight", rounded(F.col("weight")))


# Their curves, and each node against its proxy

view("tree_grown", """SELECT fold_id, arm, h.date, instrument, weight, product(1 + h.ret) OVER (PARTITION BY fold_id, arm, instrument ORDER BY h.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM tree_arms JOIN hold h USING (fold_id, instrument)""")
view("tree_curves", """SELECT arm, fold_id, date, v / coalesce(lag(v) OVER (PARTITION BY arm, fold_id ORDER BY date), 1) - 1 AS ret FROM (SELECT arm, fold_id, date, 1 + sum(weight * (g - 1)) AS v FROM tree_grown GROUP BY ALL)""")


@shared
def tree_curves(spark, sf):
    return le.ledger_returns(le.growth(tree_arms(spark, sf), hold(spark, sf)))


@query("tree_arm_returns", "SELECT arm, fold_id, date, round(ret, 8) + 0.0 AS ret FROM tree_curves")
def tree_arm_returns(spark, sf):
    return tree_curves(spark, sf).withColumn("ret", rounded(F.col("ret"), 8))


@query("tree_node_value", """WITH s AS (SELECT arm, count(*) AS days, avg(ret) / stddev_samp(ret) * sqrt(252.0) AS sharpe FROM tree_curves GROUP BY 1)
SELECT substr(n.arm, 6) AS node_id, n.days, round(n.sharpe, 6) + 0.0 AS node_sharpe, round(f.sharpe, 6) + 0.0 AS father_sharpe, round(n.sharpe - f.sharpe, 6) + 0.0 AS delta FROM s n JOIN s f ON f.arm = 'FATHER:' || substr(n.arm, 6) WHERE starts_with(n.arm, 'NODE:')""")
def tree_node_value(spark, sf):
    done = tree_curves(spark, sf).groupBy("arm").agg(F.count("*").alias("days"), (F.try_divide(F.avg("ret"), F.stddev_samp("ret")) * F.sqrt(F.lit(252.0))).alias("sharpe"))
    side = lambda prefix: done.where(F.col("arm").startswith(prefix)).withColumn("node_id", F.substring("arm", len(prefix) + 1, 100))
    both = side("NODE:").join(side("FATHER:").select("node_id", F.col("sharpe").alias("father")), "node_id")
    return both.select("node_id", "days", rounded(F.col("sharpe")).alias("node_sharpe"), rounded(F.col("father")).alias("father_sharpe"), rounded(F.col("sharpe") - F.col("father")).alias("delta"))


@query("flat_allocation", "SELECT fold_id, instrument, round(weight, 6) + 0.0 AS weight FROM max_return_w WHERE abs(weight) > 1e-12")
def flat_allocation(spark, sf):
    return best_return(spark, sf).where("abs(weight) > 1e-12").withColumn("weight", rounded(F.col("weight")))


# Baselines on the same folds: equal, declared, three minimum variances, hierarchical risk parity


@shared
def baseline_arms(spark, sf):
    rows, t = means(spark, sf), train(spark, sf)
    folds = rows.select("fold_id").distinct()
    equal = rows.join(rows.groupBy("fold_id").agg((1.0 / F.count("*")).alias("weight")), "fold_id").select("fold_id", "instrument", "weight")
    shrunk = mo.shrunk_covariance(t)
    parts = {
        "EQUAL_WEIGHT": equal,
        "DECLARED_BENCHMARK": folds.crossJoin(F.broadcast(benchmark(spark, sf))).select("fold_id", "instrument", "weight"),  # one row an instrument
        "SAMPLE_MIN_VARIANCE": al.minimum_variance(covariances(spark, sf)),
        "SHRUNK_FIXED_MIN_VARIANCE": al.minimum_variance(shrunk),
        "LEDOIT_WOLF_MIN_VARIANCE": al.minimum_variance(mo.ledoit_wolf(t)),
        "HRP_WARD_PEARSON": al.hierarchical_risk_parity(shrunk),
    }
    out = None
    for name, part in parts.items():
        part = part.select("fold_id", F.lit(name).alias("arm"), "instrument", "weight")
        out = part if out is None else out.unionByName(part)
    return out


@shared
def baseline_net(spark, sf):
    arms = baseline_arms(spark, sf)
    grown = le.growth(arms, hold(spark, sf))
    return le.net_returns(le.ledger_returns(grown), le.turnover_costs(arms, le.drifted_weights(grown), BPS))


@query("baseline_curves")
def baseline_curves(spark, sf):
    """Net daily returns of all six arms; those that SQL can follow are compared in declared_baseline_curves, the rest by their conditions in the tests."""
    return baseline_net(spark, sf)


@query("declared_baseline_curves", "SELECT CASE arm WHEN 'EQUAL' THEN 'EQUAL_WEIGHT' ELSE 'DECLARED_BENCHMARK' END AS arm, fold_id, date, round(ret, 8) + 0.0 AS ret FROM net WHERE arm IN ('EQUAL', 'BENCH')")
def declared_baseline_curves(spark, sf):
    return baseline_net(spark, sf).where("arm IN ('EQUAL_WEIGHT', 'DECLARED_BENCHMARK')").withColumn("ret", rounded(F.col("ret"), 8))


view("variances", "SELECT fold_id, node_id, i AS instrument, cov AS var FROM cov_s JOIN sleeves ON i = instrument WHERE i = j")


@query("alloc_tree_inverse_variance", """WITH leaf AS (SELECT fold_id, node_id, instrument, (1 / var) / sum(1 / var) OVER (PARTITION BY fold_id, node_id) AS weight FROM variances),
top AS (SELECT a.fold_id, a.node_id, 1 / sum(a.weight * b.weight * cov) AS inv FROM cov_s c JOIN leaf a ON a.fold_id = c.fold_id AND a.instrument = i JOIN leaf b ON b.fold_id = c.fold_id AND b.instrument = j AND b.node_id = a.node_id GROUP BY ALL)
SELECT fold_id, instrument, round(weight * inv / total, 6) + 0.0 AS weight FROM leaf JOIN (SELECT *, sum(inv) OVER (PARTITION BY fold_id) AS total FROM top) USING (fold_id, node_id)""")
def alloc_tree_inverse_variance(spark, sf):
    cov, where = covariances(spark, sf), sleeves(spark, sf)
    own = cov.where("i = j").select("fold_id", F.col("i").alias("child_id"), F.col("cov").alias("var"))
    leaf = hi.inverse_variance_split(where.select(F.col("node_id").alias("parent_id"), F.col("instrument").alias("child_id")), own, ["fold_id"]).select("fold_id", F.col("parent_id").alias("node_id"), F.col("child_id").alias("instrument"), "weight")
    a, b = (leaf.select("fold_id", F.col("node_id").alias(f"n{c}"), F.col("instrument").alias(c), F.col("weight").alias(f"w{c}")) for c in ("i", "j"))
    var = cov.join(a, ["fold_id", "i"]).join(b, ["fold_id", "j"]).where("ni = nj").groupBy("fold_id", F.col("ni").alias("child_id")).agg(F.sum(F.col("wi") * F.col("wj") * F.col("cov")).alias("var"))
    top = hi.inverse_variance_split(sleeve_edges(spark, sf), var, ["fold_id"])
    start = top.select("fold_id").distinct().select("fold_id", F.lit("ROOT").alias("node_id"))
    return hi.compose(start, top, leaf).withColumn("weight", rounded(F.col("weight")))


@query("synthetic_benchmark", """WITH b AS (SELECT 'ticker:CORE' AS instrument, sum(CASE WHEN p_size < 25 THEN 1.0 ELSE 0 END) / count(*) AS weight FROM part UNION ALL SELECT 'ticker:OTHER', 1 - sum(CASE WHEN p_size < 25 THEN 1.0 ELSE 0 END) / count(*) FROM part),
w AS (SELECT DISTINCT node_id, instrument, 1.0 / count(*) OVER (PARTITION BY node_id) AS inner_ FROM sleeves)
SELECT coalesce(w.instrument, b.instrument) AS instrument, round(sum(b.weight * coalesce(w.inner_, 1)), 8) + 0.0 AS weight FROM b LEFT JOIN w ON b.instrument = 'ticker:' || w.node_id GROUP BY 1""")
def synthetic_benchmark(spark, sf):
    from pyspark.sql import Window

    share = table(spark, sf, "part").agg(F.avg((F.col("p_size") < 25).cast("double")).alias("w"))
    bench = share.select(F.lit("ticker:CORE").alias("instrument"), F.col("w").alias("weight")).union(share.select(F.lit("ticker:OTHER"), 1 - F.col("w")))
    inner = sleeves(spark, sf).withColumn("weight", 1.0 / F.count("*").over(Window.partitionBy("node_id")))
    return hi.implemented_benchmark(bench, proxies(spark, sf), inner).withColumn("weight", rounded(F.col("weight"), 8))


@query("fold_audit_series", "SELECT fold_id, date, node_id AS series, 'synthetic' AS kind, round(ret, 8) + 0.0 AS ret FROM synthetic UNION ALL SELECT fold_id, date, node_id, 'father', round(ret, 8) + 0.0 FROM proxy_rows UNION ALL SELECT fold_id, date, instrument, 'raw', round(ret, 8) + 0.0 FROM train")
def fold_audit_series(spark, sf):
    t = train(spark, sf)
    father = t.join(sleeves(spark, sf), "instrument").groupBy("fold_id", "date", F.col("node_id").alias("series")).agg(F.avg("ret").alias("ret"))
    out = synthetic(spark, sf).select("fold_id", "date", F.col("node_id").alias("series"), F.lit("synthetic").alias("kind"), "ret")
    out = out.unionByName(father.withColumn("kind", F.lit("father"))).unionByName(t.withColumnRenamed("instrument", "series").withColumn("kind", F.lit("raw")))
    return out.withColumn("ret", rounded(F.col("ret"), 8))


view("forward_rows", "SELECT fold_id, node_id, date, sum(weight * ret) AS ret FROM fwd_w JOIN train USING (fold_id, instrument) GROUP BY ALL")
view("result_rows", "SELECT fold_id, top AS node_id, date, sum(weight * ret) AS ret FROM back_held JOIN train USING (fold_id, instrument) GROUP BY ALL")


def father_proxies(spark):
    return slots(spark)[0].where("child_id IS NOT NULL").select(F.col("child_id").alias("node_id"), F.col("instrument").alias("proxy"))


@query("tree_audit_series", """SELECT fold_id, date, series, round(ret, 8) + 0.0 AS ret FROM (SELECT fold_id, date, 'RAW:' || instrument AS series, ret FROM train
  UNION ALL SELECT fold_id, date, 'REFERENCE:B0_RAW', sum(weight * ret) FROM train JOIN bench USING (instrument) GROUP BY ALL
  UNION ALL SELECT fold_id, date, 'REFERENCE:FATHER:' || node_id, ret FROM train JOIN father ON proxy = instrument UNION ALL SELECT fold_id, date, 'FORWARD_OUTPUT:' || node_id, ret FROM forward_rows
  UNION ALL SELECT fold_id, date, 'RESULT_OUTPUT:' || node_id, ret FROM result_rows UNION ALL SELECT fold_id, date, 'BACKWARD_INPUT:' || proxy || '_SYNTH', ret FROM result_rows JOIN father USING (node_id)
  UNION ALL SELECT fold_id, date, 'DIAGNOSTIC:B0_SYNTH', sum(weight * ret) FROM train JOIN tree_arms USING (fold_id, instrument) WHERE arm = 'B0_SYNTH' GROUP BY ALL)""")
def tree_audit_series(spark, sf):
    back = held_by_nodes(spark, sf, "back").withColumnRenamed("top", "node_id")
    built = tree_arms(spark, sf).where("arm = 'B0_SYNTH'").drop("arm")
    done = le.audit_series(train(spark, sf), benchmark(spark, sf), father_proxies(spark), forward_weights(spark, sf).drop("child_id"), back, built)
    return done.withColumn("ret", rounded(F.col("ret"), 8))


#: What a node's volatility may refer to here; the last but one is reserved, the last is unknown.
REFERENCES = ("manual", "benchmark", "father_proxy", "forward_root_reference", "current_root_synthetic", "mother")

view("asked_targets", "SELECT node_id, node_id = 'ROOT' AS is_root, proxy, reference FROM (SELECT DISTINCT node_id FROM slots) LEFT JOIN father USING (node_id) CROSS JOIN (VALUES " + ", ".join(f"('{r}')" for r in REFERENCES) + ") r(reference)")
view("measured_targets", """SELECT fold_id, 'benchmark' AS reference, NULL AS proxy, stddev_samp(ret) * sqrt(252.0) AS measured FROM (SELECT fold_id, date, sum(weight * ret) AS ret FROM train JOIN bench USING (instrument) GROUP BY ALL) GROUP BY 1
  UNION ALL SELECT fold_id, 'forward_root_reference', NULL, stddev_samp(ret) * sqrt(252.0) FROM forward_rows WHERE node_id = 'ROOT' GROUP BY 1 UNION ALL SELECT fold_id, 'father_proxy', instrument, stddev_samp(ret) * sqrt(252.0) FROM train GROUP BY ALL""")


@query("reference_targets", """SELECT f.fold_id, a.node_id, a.reference, CASE a.reference WHEN 'manual' THEN 0.12 ELSE round(CASE WHEN is_root AND a.reference = 'forward_root_reference' THEN NULL ELSE measured END, 6) END AS target,
  CASE WHEN a.reference = 'current_root_synthetic' THEN 'reference is reserved' WHEN a.reference = 'mother' THEN 'unsupported reference' WHEN is_root AND a.reference = 'forward_root_reference' THEN 'forward reference on the root'
    WHEN a.reference = 'father_proxy' AND a.proxy IS NULL THEN 'father reference requires a proxy' WHEN a.reference <> 'manual' AND measured IS NULL THEN 'reference series missing' END AS problem
  FROM (SELECT DISTINCT fold_id FROM train) f CROSS JOIN asked_targets a LEFT JOIN measured_targets m ON m.fold_id = f.fold_id AND m.reference = a.reference AND (m.proxy IS NULL OR m.proxy = a.proxy)""")
def reference_targets(spark, sf):
    """Every node of the three-level tree under every reference, in every fold."""
    kinds = spark.createDataFrame([(r,) for r in REFERENCES], "reference string")
    nodes = slots(spark)[1].select("node_id").join(father_proxies(spark), "node_id", "left").crossJoin(kinds)
    nodes = nodes.select("node_id", (F.col("node_id") == "ROOT").alias("is_root"), "proxy", "reference", F.lit(0.12).alias("manual"))
    root = hi.node_series(forward_weights(spark, sf).where("node_id = 'ROOT'").select("fold_id", "node_id", "instrument", "weight"), train(spark, sf), ["fold_id"])
    return al.reference_targets(nodes, train(spark, sf), benchmark(spark, sf), root, 252).withColumn("target", F.round("target", 6))


# Contraction of the wide tree under decisions taken from its suppliers' balances

view("tree_decisions", "SELECT child_id AS node_id, CASE WHEN CAST(substr(child_id, 2) AS BIGINT) * 7 % 10 < 4 THEN 'prune' ELSE 'retain' END AS decision FROM edges")
view("acted", """SELECT 'ROOT' AS node_id, 0 AS depth, false AS pruned, false AS up, CAST(NULL AS VARCHAR) AS parent, false AS cut, 'kept' AS action, CAST(NULL AS VARCHAR) AS new_parent
  UNION ALL SELECT node_id, depth, pruned, CASE WHEN action = 'lifted' THEN false ELSE p_pruned END, CASE WHEN action = 'lifted' THEN p_parent ELSE parent_id END, p_cut OR (NOT p_cut AND p_pruned AND p_up), action,
    CASE action WHEN 'lifted' THEN p_parent WHEN 'kept' THEN parent_id END FROM (
    SELECT e.child_id AS node_id, w.depth + 1 AS depth, d.decision = 'prune' AS pruned, e.parent_id, w.pruned AS p_pruned, w.up AS p_up, w.parent AS p_parent, w.cut AS p_cut,
      CASE WHEN w.cut THEN 'removed_with_ancestor' WHEN NOT w.pruned THEN CASE WHEN d.decision = 'prune' THEN 'contracted' ELSE 'kept' END WHEN w.up THEN 'removed_with_ancestor' WHEN d.decision = 'prune' THEN 'removed_with_ancestor' ELSE 'lifted' END AS action
    FROM acted w JOIN edges e ON e.parent_id = w.node_id JOIN tree_decisions d ON d.node_id = e.child_id)""")


def acted(spark, sf):
    e = edges(spark, sf)
    tree = hi.walk(e, roots(spark)).select("node_id").join(e.withColumnRenamed("child_id", "node_id"), "node_id", "left")
    decided = e.select(F.col("child_id").alias("node_id"), F.when(F.substring("child_id", 2, 20).cast("long") * 7 % 10 < 4, "prune").otherwise("retain").alias("decision"))
    return pru.contraction(tree, decided)


@query("prune_actions", "SELECT node_id, action, new_parent FROM acted WHERE node_id <> 'ROOT'")
def prune_actions(spark, sf):
    return acted(spark, sf)


@query("pruned_tree_edges", "SELECT new_parent AS parent_id, node_id AS child_id FROM acted WHERE node_id <> 'ROOT' AND action IN ('kept', 'lifted')")
def pruned_tree_edges(spark, sf):
    return pru.pruned_edges(acted(spark, sf))
