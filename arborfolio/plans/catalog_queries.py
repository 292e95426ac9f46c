"""Queries on catalogs, configs, histories, regimes and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from arborfolio.functions.periods import rounded
from arborfolio.operators import catalog as ca
from arborfolio.operators import ledger as le
from arborfolio.operators import regimes as rg
from arborfolio.operators.hierarchy import by_mean_return
from arborfolio.plans.allocation_queries import fill_sql
from arborfolio.plans.ledger_queries import BPS
from arborfolio.plans.panel_queries import rolling, train, valuation
from arborfolio.plans.registry import query, view
from arborfolio.sources.prices import brand_levels, table
from arborfolio.sources.written import shared
from arborfolio.streaming import jobs

# Catalog: brands are listings, parts their instruments

view("coverage", "SELECT substr(instrument, 8) AS symbol, count(*) AS observations, min(date) AS first_date, max(date) AS last_date FROM brand_levels GROUP BY 1")
view("listings", "SELECT DISTINCT upper(p_brand) AS symbol, p_brand AS name FROM part")
view("kinds", "SELECT upper(p_brand) AS symbol, min(p_type) AS kind, CAST(count(*) AS VARCHAR) AS \"group\" FROM part GROUP BY 1")


def coverage(spark, sf):
    return brand_levels(spark, sf).groupBy(F.substring("instrument", 8, 50).alias("symbol")).agg(F.count("*").alias("observations"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def kinds(spark, sf):
    return table(spark, sf, "part").groupBy(F.upper("p_brand").alias("symbol")).agg(F.min("p_type").alias("kind"), F.count("*").cast("string").alias("group"))


@query("catalog_search", """SELECT l.symbol, l.name, k.kind, c.observations, c.first_date, c.last_date FROM listings l JOIN kinds k USING (symbol) LEFT JOIN coverage c USING (symbol)
  WHERE contains(upper(concat_ws(' ', l.symbol, l.name, k.kind, k."group")), 'BRAND#1') AND coalesce(c.observations, 0) >= 10 ORDER BY l.symbol <> 'BRAND#1', l.symbol LIMIT 20""")
def catalog_search(spark, sf):
    listings, *known = catalog(spark, sf)
    found = ca.search(listings.select("symbol", F.lit("").alias("exchange"), F.lit(None).cast("date").alias("active_to")).distinct(), *known, "Brand#1", 10, limit=20)
    return found.select("symbol", "name", "kind", "observations", "first_date", "last_date")


view("traded", "SELECT DISTINCT upper(p_brand) AS symbol, p_type AS exchange FROM part WHERE NOT ends_with(p_brand, '5')")
view("classes", "SELECT upper(p_brand) AS symbol, min(p_type) AS asset_class, 'size ' || min(p_size) AS area, max(p_type) AS category, 'size ' || max(p_size) AS sub_group, min(p_name) AS sector, max(p_name) AS theme FROM part GROUP BY 1")


def catalog(spark, sf):
    """Listings (brands ending in 5 are no longer traded), instruments, their classes and coverage."""
    part, symbol = table(spark, sf, "part"), F.upper("p_brand").alias("symbol")
    left = F.when(F.col("p_brand").endswith("5"), F.lit("1998-01-01").cast("date"))
    listings = part.select(symbol, F.col("p_type").alias("exchange"), left.alias("active_to")).distinct()
    names = part.groupBy(symbol).agg(F.min("p_brand").alias("name"), F.min("p_type").alias("kind"))
    size = lambda end: F.concat(F.lit("size "), end("p_size").cast("string"))
    fields = {"asset_class": F.min("p_type"), "area": size(F.min), "category": F.max("p_type"), "sub_group": size(F.max), "sector": F.min("p_name"), "theme": F.max("p_name")}
    classes = part.groupBy(F.col("p_brand").alias("symbol")).agg(*(c.alias(n) for n, c in fields.items()))
    return listings, names, classes, coverage(spark, sf)


@query("catalog_filtered", """SELECT symbol, exchange, l.name, k.kind, area, theme, coalesce(c.observations, 0) AS observations, c.first_date FROM traded t JOIN (SELECT symbol, min(name) AS name FROM listings GROUP BY 1) l USING (symbol) JOIN kinds k USING (symbol)
  JOIN classes USING (symbol) LEFT JOIN coverage c USING (symbol) WHERE c.observations >= 20 AND c.first_date <= DATE '1996-06-01' AND (symbol LIKE '%1%' OR upper(l.name) LIKE '%1%' OR upper(asset_class) LIKE '%1%' OR upper(area) LIKE '%1%'
  OR upper(category) LIKE '%1%' OR upper(sub_group) LIKE '%1%' OR upper(sector) LIKE '%1%' OR upper(theme) LIKE '%1%') ORDER BY symbol <> '1', symbol, exchange LIMIT 100""")
def catalog_filtered(spark, sf):
    """Traded listings with a 1 in any field, 20 observations and prices since June 1996."""
    found = ca.search(*catalog(spark, sf), "1", 20, "1996-06-01")
    return found.select("symbol", "exchange", "name", "kind", "area", "theme", "observations", "first_date")


@query("instrument_labels", "SELECT symbol, name || ' (' || kind || ')' AS label FROM listings JOIN kinds USING (symbol)")
def instrument_labels(spark, sf):
    listings = table(spark, sf, "part").select(F.upper("p_brand").alias("symbol"), F.col("p_brand").alias("name")).distinct()
    return listings.join(kinds(spark, sf), "symbol").select("symbol", F.format_string("%s (%s)", "name", "kind").alias("label"))


@query("normalized_symbols", "SELECT DISTINCT upper(trim(p_name)) AS symbol FROM part WHERE trim(p_name) <> ''")
def normalized_symbols(spark, sf):
    p = table(spark, sf, "part")
    mixed = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" Ticker:"), "p_name", F.lit(" "))).otherwise(F.lower("p_name"))
    return ca.normalized_symbols(p.select(mixed.alias("name")))


@query("data_fingerprint", "SELECT sha256(string_agg(symbol || '|' || last_date || '|' || observations, chr(10) ORDER BY symbol || '|' || last_date || '|' || observations)) AS fingerprint, CAST(max(last_date) AS VARCHAR) AS as_of FROM coverage")
def data_fingerprint(spark, sf):
    return ca.fingerprint(coverage(spark, sf))


# Each order is a tree: its lines' brands, none where a line came back, unknown ones where it is open

view("order_symbols", "SELECT DISTINCT l_orderkey AS tree_id, CASE WHEN l_returnflag = 'R' THEN NULL WHEN l_linestatus = 'O' THEN 'OPEN ' || upper(p_brand) ELSE upper(p_brand) END AS symbol FROM lineitem JOIN part ON p_partkey = l_partkey")


@query("model_fingerprints", """SELECT tree_id, CAST(max(last_date) AS VARCHAR) AS as_of, CASE WHEN count(o.symbol) = 0 THEN 'no-instruments' WHEN count(c.symbol) = 0 THEN 'no-coverage'
  ELSE sha256('[' || string_agg('["' || c.symbol || '","' || last_date || '","' || observations || '","run-' || year(last_date) || '"]', ',' ORDER BY c.symbol) || ']') END AS fingerprint
  FROM order_symbols o LEFT JOIN coverage c ON c.symbol = o.symbol GROUP BY 1""")
def model_fingerprints(spark, sf):
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
    name = F.when(F.col("l_returnflag") != "R", F.when(F.col("l_linestatus") == "O", F.concat(F.lit("ticker:open "), "p_brand")).otherwise(F.concat(F.lit("ticker: "), "p_brand")))
    run = F.concat(F.lit("run-"), F.year("last_date").cast("string"))
    return ca.fingerprints(lines.select(F.col("l_orderkey").alias("tree_id"), name.alias("instrument")), coverage(spark, sf).withColumn("run", run))


# Configs: one JSON text for each customer

#: Which customers (number modulo 40) get which other field, as SQL that both engines read.
FLAWS = {
    "covariance_estimator": {1: "'oas'", 2: "'ledoit_wolf'"}, "view_covariance_policy": {3: "'mixed'"}, "volatility_target_mode": {4: "'below'", 5: "'cap'", 6: "'at_most'"},
    "volatility_reference": {7: "'current_root_synthetic'", 8: "'benchmark'"}, "mean_reference_kind": {9: "'father_proxy'", 10: "'local_weights'", 11: "'local_weights'", 12: "'local_weights'"},
    "tracking_error_policy": {14: "'relax'"}, "volatility_target_policy": {15: "'nearest_feasible'", 36: "'relax'"}, "volatility_cap_policy": {16: "'nearest_feasible'"}, "currency": {17: "'CHF'", 18: "'EUR'"},
    "risk_aversion": {19: "0.0", 20: "2.5"}, "view_tau": {21: "-0.5"}, "per_asset_cap": {22: "1.5", 23: "-0.25"}, "vol_target": {5: "0.125", 24: "-0.125", 25: "0.25"}, "max_volatility": {5: "0.25", 6: "0.25"},
    "max_tracking_error": {26: "-1.0"}, "maximum_turnover": {27: "0.5"}, "max_turnover": {28: "0.0"}, "cash_enabled": {29: "true", 30: "true"}, "allow_cash": {29: "false", 31: "true"},
    "weight_a": {11: "0.75", 12: "0.5", 13: "1.0"}, "weight_b": {11: "0.25", 12: "0.25", 13: "0.0"}, "view_confidence": {32: "0.0", 33: "1.5", 34: "0.5", 35: "0.5"}, "view_on": {32: "'ticker:A'", 34: "' CASH:RF@N1'", 35: "'ticker:B'"},
}
FLAW_COLUMNS = [f"CASE c_custkey % 40 {' '.join(f'WHEN {k} THEN {v}' for k, v in cases.items())} END AS {name}" for name, cases in FLAWS.items()]

view("config_in", f"""SELECT c_custkey AS tree_id, CASE c_custkey % 9 WHEN 0 THEN 'best' WHEN 1 THEN NULL WHEN 2 THEN 'max_return' WHEN 3 THEN 'hrp' ELSE 'min_risk' END AS objective, CASE c_nationkey % 5 WHEN 0 THEN 0.5 WHEN 1 THEN NULL ELSE 1.5 END AS leverage,
  CASE c_custkey % 7 WHEN 0 THEN -1.0 WHEN 1 THEN NULL ELSE 25.0 END AS spread, (c_custkey % 13) / 10.0 AS confidence, (c_custkey % 12) / 10.0 AS lo, (c_custkey % 8) / 10.0 AS hi, {", ".join(FLAW_COLUMNS)} FROM customer""")
view("config_v", "SELECT * REPLACE (coalesce(objective, 'min_risk') AS objective, coalesce(leverage, 1.0) AS leverage, coalesce(spread, 0.0) AS spread) FROM config_in")


def configs(spark, sf):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    objective = F.when(k % 9 == 0, "best").when(k % 9 == 2, "max_return").when(k % 9 == 3, "hrp").when(k % 9 != 1, "min_risk")
    leverage = F.when(n % 5 == 0, 0.5).when(n % 5 != 1, 1.5)
    spread = F.when(k % 7 == 0, -1.0).when(k % 7 != 1, 25.0)
    maps = lambda v: F.create_map(F.lit("ticker:A"), v)
    flawed = table(spark, sf, "customer").selectExpr("c_custkey", "c_nationkey", *FLAW_COLUMNS)
    extra = [F.col(name) for name in FLAWS if name not in ("weight_a", "weight_b", "view_confidence", "view_on")]
    weights = F.when(F.col("weight_a").isNotNull(), F.create_map(F.lit("ticker:A"), "weight_a", F.lit("ticker:B"), "weight_b")).alias("mean_reference_weights")
    picks = F.when(F.col("view_on").isNotNull(), F.create_map(F.coalesce("view_on", F.lit("")), F.lit(1.0)))
    views = F.when(F.col("view_confidence").isNotNull(), F.array(F.struct(F.col("view_confidence").alias("confidence"), picks.alias("coefficients")))).alias("views")
    known = [F.concat(F.lit("N"), k.cast("string")).alias("node_id"), objective.alias("objective"), leverage.alias("leverage"), spread.alias("spread"), ((k % 13) / 10).alias("confidence"), maps((k % 12) / 10).alias("min_weights"), maps((k % 8) / 10).alias("max_weights")]
    return flawed.select(k.alias("tree_id"), F.to_json(F.struct(*known, *extra, weights, views)).alias("body"))


@query("config_nodes", "SELECT tree_id, 'N' || tree_id AS node_id, objective, round(leverage, 6) AS leverage, round(spread, 6) AS spread, round(confidence, 6) AS confidence FROM config_v")
def config_nodes(spark, sf):
    return ca.parse_configs(configs(spark, sf)).select("tree_id", "node_id", "objective", *(F.round(c, 6).alias(c) for c in ("leverage", "spread", "confidence")))


@query("config_bounds", "SELECT tree_id, 'ticker:A' AS instrument, round(lo, 6) AS lo, round(hi, 6) AS hi FROM config_v")
def config_bounds(spark, sf):
    return ca.config_bounds(ca.parse_configs(configs(spark, sf))).select("tree_id", "instrument", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


RULES_SQL = {
    "objective": "objective NOT IN ('min_risk', 'max_return', 'max_ratio', 'max_utility', 'hrp')", "leverage": "leverage < 1", "spread": "spread < 0", "spread without financing": "spread > 0 AND leverage <= 1 AND NOT coalesce(cash_enabled, allow_cash, false)",
    "confidence": "confidence <= 0 OR confidence > 1", "bound range": "lo NOT BETWEEN 0 AND 1 OR hi NOT BETWEEN 0 AND 1", "crossed bounds": "lo > hi",
    "covariance_estimator": "covariance_estimator NOT IN ('shrunk_fixed', 'ledoit_wolf')", "view_covariance_policy": "view_covariance_policy NOT IN ('prior_risk', 'posterior_all')", "volatility_target_mode": "volatility_target_mode NOT IN ('exact', 'cap', 'at_most')",
    "mean_reference_kind": "mean_reference_kind NOT IN ('none', 'benchmark', 'local_weights')", "tracking_error_policy": "tracking_error_policy NOT IN ('hard_fail', 'nearest_feasible')", "volatility_target_policy": "volatility_target_policy NOT IN ('hard_fail', 'nearest_feasible')",
    "volatility_cap_policy": "volatility_cap_policy <> 'hard_fail'", "currency": "currency NOT IN ('USD', 'EUR', 'GBP', 'JPY')", "reserved reference": "volatility_reference IN ('current_parent_synthetic', 'current_root_synthetic')",
    "reference weights missing": "mean_reference_kind = 'local_weights' AND weight_a IS NULL", "reference weights sum": "mean_reference_kind = 'local_weights' AND abs(weight_a + weight_b - 1) > 1e-6", "reference weights unused": "coalesce(mean_reference_kind, 'none') <> 'local_weights' AND weight_a IS NOT NULL",
    "turnover": "maximum_turnover IS NOT NULL OR max_turnover IS NOT NULL", "risk aversion": "risk_aversion <= 0", "view tau": "view_tau <= 0", "negative limit": "least(per_asset_cap, vol_target, max_volatility, max_tracking_error) < 0", "asset cap": "per_asset_cap > 1",
    "two caps": "volatility_target_mode IN ('cap', 'at_most') AND vol_target IS NOT NULL AND max_volatility IS NOT NULL", "cash contradiction": "cash_enabled <> allow_cash",
    "view confidence": "view_confidence <= 0 OR view_confidence > 1", "view without coefficients": "view_confidence IS NOT NULL AND view_on IS NULL", "view on financing": "lower(trim(view_on)) LIKE 'cash:rf%' OR lower(trim(view_on)) LIKE 'cash:borrow%'",
}


@query("config_violations", " UNION ALL ".join(f"SELECT tree_id, '{rule}' AS rule FROM config_v WHERE {test}" for rule, test in RULES_SQL.items()))
def config_violations(spark, sf):
    return ca.config_violations(ca.parse_configs(configs(spark, sf)))


# A flawed tree: suppliers under nations; every 40th id is listed twice, every 25th hangs under two parents, every 30th edge leads
# nowhere, every tenth proxy and every 35th name is the same, and some nations hold a child's proxy or an instrument twice

view("flawed_nodes", """SELECT 'ROOT' AS node_id, CAST(NULL AS VARCHAR) AS proxy, CAST(NULL AS VARCHAR) AS name UNION ALL SELECT 'N' || n_nationkey, 'x' || n_nationkey, n_name FROM nation
  UNION ALL SELECT 'S' || s_suppkey, CASE WHEN s_suppkey % 6 = 0 THEN NULL WHEN s_suppkey % 10 = 3 THEN 'same' ELSE 'p' || s_suppkey END, CASE WHEN s_suppkey % 35 = 5 THEN 'same' END FROM supplier
  UNION ALL SELECT 'S' || s_suppkey, 'x', NULL FROM supplier WHERE s_suppkey % 40 = 1 UNION ALL SELECT 'LOST' || s_suppkey, 'x', NULL FROM supplier WHERE s_suppkey % 33 = 2""")
view("flawed_held", "SELECT 'N' || s_nationkey AS node_id, 'p' || s_suppkey AS instrument FROM supplier WHERE s_suppkey % 20 = 7 UNION ALL SELECT 'N' || s_nationkey, 'own' || (s_suppkey % 4) FROM supplier")
view("flawed_proxies", "SELECT DISTINCT e.parent_id, n.node_id, n.proxy FROM flawed_edges e JOIN flawed_nodes n ON n.node_id = e.child_id WHERE n.proxy IS NOT NULL")
view("flawed_edges", "SELECT 'ROOT' AS parent_id, 'N' || n_nationkey AS child_id FROM nation UNION ALL SELECT 'N' || s_nationkey, CASE WHEN s_suppkey % 30 = 3 THEN 'X' || s_suppkey ELSE 'S' || s_suppkey END FROM supplier UNION ALL SELECT 'N' || ((s_nationkey + 1) % 25), 'S' || s_suppkey FROM supplier WHERE s_suppkey % 25 = 4 UNION ALL SELECT 'N' || s_nationkey, 'ROOT' FROM supplier WHERE s_suppkey = 5")
view("flawed_ways", "SELECT a, b FROM (WITH RECURSIVE w AS (SELECT parent_id AS a, child_id AS b FROM flawed_edges UNION SELECT w.a, e.child_id FROM w JOIN flawed_edges e ON e.parent_id = w.b) SELECT * FROM w)")
view("flawed_reach", "SELECT 'ROOT' AS node_id, 0 AS d UNION ALL SELECT e.child_id, r.d + 1 FROM flawed_reach r JOIN flawed_edges e ON e.parent_id = r.node_id WHERE e.child_id <> 'ROOT'")


@query("tree_violations", """SELECT node_id, 'duplicate id' AS rule FROM flawed_nodes GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT DISTINCT child_id, 'unknown child' FROM flawed_edges WHERE child_id NOT IN (SELECT node_id FROM flawed_nodes)
  UNION ALL SELECT child_id, 'two parents' FROM flawed_edges GROUP BY 1 HAVING count(DISTINCT parent_id) > 1 UNION ALL SELECT DISTINCT child_id, 'root as child' FROM flawed_edges WHERE child_id = 'ROOT'
  UNION ALL SELECT DISTINCT node_id, 'missing proxy' FROM flawed_nodes WHERE node_id <> 'ROOT' AND proxy IS NULL UNION ALL SELECT DISTINCT node_id, 'unreachable' FROM flawed_nodes WHERE node_id NOT IN (SELECT node_id FROM flawed_reach)
  UNION ALL SELECT DISTINCT node_id, 'duplicate name' FROM flawed_nodes WHERE coalesce(name, node_id) IN (SELECT coalesce(name, node_id) FROM flawed_nodes GROUP BY 1 HAVING count(DISTINCT node_id) > 1)
  UNION ALL SELECT DISTINCT p.node_id, 'shared proxy' FROM flawed_proxies p JOIN flawed_proxies q ON p.parent_id = q.parent_id AND p.proxy = q.proxy AND p.node_id <> q.node_id
  UNION ALL SELECT DISTINCT p.node_id, 'colliding proxy' FROM flawed_proxies p JOIN flawed_held h ON h.node_id = p.parent_id AND h.instrument = p.proxy
  UNION ALL SELECT DISTINCT a, 'cycle' FROM flawed_ways WHERE a = b
  UNION ALL SELECT DISTINCT node_id, 'duplicate instrument' FROM (SELECT node_id, instrument FROM flawed_held GROUP BY 1, 2 HAVING count(*) > 1)""")
def tree_violations(spark, sf):
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    k = F.col("s_suppkey")
    none = F.lit(None).cast("string")
    nodes = spark.range(1).select(F.lit("ROOT").alias("node_id"), none.alias("proxy"), none.alias("name")).union(n.select(name("N", "n_nationkey"), name("x", "n_nationkey"), "n_name"))
    nodes = nodes.union(s.select(name("S", "s_suppkey"), F.when(k % 6 != 0, F.when(k % 10 == 3, "same").otherwise(name("p", "s_suppkey"))), F.when(k % 35 == 5, "same")))
    nodes = nodes.union(s.where(k % 40 == 1).select(name("S", "s_suppkey"), F.lit("x"), none)).union(s.where(k % 33 == 2).select(name("LOST", "s_suppkey"), F.lit("x"), none))
    held = s.where(k % 20 == 7).select(name("N", "s_nationkey").alias("node_id"), name("p", "s_suppkey").alias("instrument")).union(s.select(name("N", "s_nationkey"), F.concat(F.lit("own"), (k % 4).cast("string"))))
    child = F.when(k % 30 == 3, name("X", "s_suppkey")).otherwise(name("S", "s_suppkey"))
    edges = n.select(F.lit("ROOT").alias("parent_id"), name("N", "n_nationkey").alias("child_id")).union(s.select(name("N", "s_nationkey"), child))
    second = F.concat(F.lit("N"), ((F.col("s_nationkey") + 1) % 25).cast("string"))
    edges = edges.union(s.where(k % 25 == 4).select(second, name("S", "s_suppkey"))).union(s.where(k == 5).select(name("N", "s_nationkey"), F.lit("ROOT")))
    return ca.tree_violations(nodes, edges, "ROOT", held)


@query("content_hash", """SELECT p_partkey AS id, 'sha256:' || sha256('{"brand":"' || p_brand || '","name":"' || p_name || '","size":"' || p_size || '","type":"' || p_type || '"}') AS hash FROM part""")
def content_hash(spark, sf):
    entries = F.create_map(F.lit("type"), "p_type", F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), "p_brand", F.lit("name"), "p_name")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), ca.content_hash(entries).alias("hash"))


@query("redact_keys", """SELECT event_id, '{"api_key":"***","k":"' || json_extract_string(props, '$.k') || '","user_Token":"***"}' AS body FROM events""")
def redact_keys(spark, sf):
    props = F.map_concat(F.from_json("props", "MAP<STRING, STRING>"), F.create_map(F.lit("user_Token"), F.col("user_id").cast("string"), F.lit("api_key"), F.col("event_id").cast("string")))
    return table(spark, sf, "events").select("event_id", ca.canonical_json(ca.redact_keys(props)).alias("body"))


@query("redact_pii")
def redact_pii(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", ca.redact_pii(F.col("text")).alias("text"))


view("history", "SELECT user_id AS entity, event_id AS seq, event_type AS status FROM events")
#: The steps that an event history may take.
LEGAL = [("signup", "view"), ("view", "click"), ("click", "view"), ("view", "purchase"), ("click", "purchase"), ("view", "error"), ("click", "error")]
view("legal", "SELECT * FROM (VALUES " + ", ".join(map(str, LEGAL)) + ") l(before, status)")


@query("illegal_transitions", "SELECT entity, seq, before, status FROM (SELECT *, lag(status) OVER (PARTITION BY entity ORDER BY seq) AS before FROM history) WHERE before IS NOT NULL AND (before, status) NOT IN (SELECT (before, status) FROM legal)")
def illegal_transitions(spark, sf):
    legal = spark.createDataFrame(LEGAL, "before string, status string")
    return ca.illegal_transitions(table(spark, sf, "events").select(F.col("user_id").alias("entity"), F.col("event_id").alias("seq"), F.col("event_type").alias("status")), legal)


view("revisions", "SELECT o_custkey AS tree_id, o_orderkey AS revision_id, o_orderdate AS created, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS parent_id FROM orders")
view("head_v", "SELECT tree_id, arg_max(revision_id, (created, revision_id)) AS revision_id FROM revisions GROUP BY 1")
view("chain_v", "SELECT tree_id, revision_id, 0 AS step FROM head_v UNION ALL SELECT c.tree_id, r.parent_id, c.step + 1 FROM chain_v c JOIN revisions r ON r.revision_id = c.revision_id WHERE r.parent_id IS NOT NULL")


def revisions(spark, sf):
    up = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("tree_id"), F.col("o_orderkey").alias("revision_id"), F.col("o_orderdate").alias("created"), up.alias("parent_id"))


@query("tree_heads", "SELECT * FROM head_v")
def tree_heads(spark, sf):
    return ca.heads(revisions(spark, sf))


@query("revision_chain", "SELECT * FROM chain_v")
def revision_chain(spark, sf):
    rows = revisions(spark, sf)
    return ca.revision_chain(rows, ca.heads(rows))


@query("unmigrated", "SELECT c_custkey AS tree_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def unmigrated(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").where("o_orderstatus = 'P'")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select(F.col("c_custkey").alias("tree_id"))


@query("latest_runs", "SELECT cache_key, run_id, created FROM (SELECT o_custkey || '-' || o_orderpriority AS cache_key, o_orderkey AS run_id, o_orderdate AS created, row_number() OVER (PARTITION BY o_custkey || '-' || o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1 ORDER BY created DESC, run_id DESC LIMIT 100")
def latest_runs(spark, sf):
    runs = table(spark, sf, "orders").select(F.concat_ws("-", F.col("o_custkey").cast("string"), "o_orderpriority").alias("cache_key"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("created"))
    return ca.latest(runs, "cache_key", ["created", "run_id"]).orderBy(F.desc("created"), F.desc("run_id")).limit(100)


@query("latest_report", "SELECT l_orderkey AS run_id, l_linenumber AS artifact FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC) AS k FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE l_returnflag = 'R')) WHERE k = 1")
def latest_report(spark, sf):
    rows = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("artifact"), "l_shipdate").distinct()
    return ca.latest(rows, "run_id", ["l_shipdate", "artifact"]).select("run_id", "artifact")


# Profiles: the winner's settings for each node, and nodes that only one profile has

view("profile_rows", "SELECT o_custkey AS node_id, o_orderstatus AS profile, count(*) AS orders, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2")
view("profile_best", "SELECT node_id, arg_min(profile, (-value, profile)) AS profile FROM profile_rows GROUP BY 1")


def profiles(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("node_id"), F.col("o_orderstatus").alias("profile")).agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("value"))


@query("apply_profiles", "SELECT node_id, profile, orders FROM profile_rows JOIN profile_best USING (node_id, profile)")
def apply_profiles(spark, sf):
    rows = profiles(spark, sf)
    best = rows.groupBy("node_id").agg(F.min_by("profile", F.struct(-F.col("value"), "profile")).alias("profile"))
    return rows.join(best, ["node_id", "profile"]).select("node_id", "profile", "orders")


@query("topology_mismatch", "SELECT coalesce(a.node_id, b.node_id) AS node_id, a.node_id IS NOT NULL AS in_first, b.node_id IS NOT NULL AS in_second FROM (SELECT node_id FROM profile_rows WHERE profile = 'O') a FULL JOIN (SELECT node_id FROM profile_rows WHERE profile = 'F') b ON a.node_id = b.node_id WHERE a.node_id IS NULL OR b.node_id IS NULL")
def topology_mismatch(spark, sf):
    rows = profiles(spark, sf)
    a, b = (rows.where(F.col("profile") == p).select("node_id", F.lit(True).alias(n)) for p, n in (("O", "in_first"), ("F", "in_second")))
    return a.join(b, "node_id", "full").where("in_first IS NULL OR in_second IS NULL").fillna(False, ["in_first", "in_second"])


# Regimes: the share of urgent orders of a day is the probability of stress

view("regimes", "SELECT CAST(o_orderdate AS DATE) AS date, CASE WHEN avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0 ELSE 0 END) > 0.25 THEN 'stress' ELSE 'calm' END AS state, avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0 ELSE 0 END) AS p FROM orders GROUP BY 1")
view("state_p", "SELECT date, 'stress' AS state, p AS weight FROM regimes UNION ALL SELECT date, 'calm', 1 - p FROM regimes")
view("state_mu", "SELECT state, instrument, sum(weight * ret) / sum(weight) AS mu FROM type_valuation JOIN state_p USING (date) GROUP BY ALL")
view("state_asof", "SELECT v.date, r.state, r.p FROM (SELECT DISTINCT date FROM resampled_w) v ASOF LEFT JOIN regimes r ON v.date >= r.date")
view("switches", "SELECT date, state FROM (SELECT *, lag(state) OVER (ORDER BY date) AS before FROM regimes) WHERE before IS NULL OR before <> state")


@shared
def regimes(spark, sf):
    p = F.avg((F.col("o_orderpriority") == "1-URGENT").cast("double"))
    daily = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(p.alias("p"))
    return daily.select("date", F.when(F.col("p") > 0.25, "stress").otherwise("calm").alias("state"), "p")


@query("regime_conditional_means", "SELECT state, instrument, round(mu, 10) + 0.0 AS mu FROM state_mu")
def regime_conditional_means(spark, sf):
    return rg.conditional_means(valuation(spark, sf), regimes(spark, sf)).withColumn("mu", rounded(F.col("mu"), 10))


@query("regime_transitions", "SELECT * FROM switches")
def regime_transitions(spark, sf):
    return rg.transitions(regimes(spark, sf))


def weekly_states(spark, sf):
    from arborfolio.plans.panel_queries import estimation

    return rg.as_of(estimation(spark, sf), regimes(spark, sf))


@query("regime_asof", "SELECT date, state, round(p, 8) AS p FROM state_asof")
def regime_asof(spark, sf):
    return weekly_states(spark, sf).withColumn("p", F.round("p", 8))


@query("regime_views", "SELECT date, instrument, round(252 * sum(weight * mu), 8) + 0.0 AS q FROM (SELECT date, 'stress' AS state, p AS weight FROM state_asof UNION ALL SELECT date, 'calm', 1 - p FROM state_asof) JOIN state_mu USING (state) GROUP BY ALL")
def regime_views(spark, sf):
    means = rg.conditional_means(valuation(spark, sf), regimes(spark, sf))
    return rg.views(means, weekly_states(spark, sf), 252).withColumn("q", rounded(F.col("q"), 8))


@query("regime_blended_weights", """WITH s AS (SELECT f.fold_id, r.p FROM folds_r f ASOF JOIN regimes r ON f.signal >= r.date),
b AS (SELECT fold_id, state, instrument FROM (SELECT fold_id, state, instrument, row_number() OVER (PARTITION BY fold_id, state ORDER BY avg(ret) DESC, instrument) AS k FROM train JOIN state_asof USING (date) GROUP BY fold_id, state, instrument HAVING count(*) >= 3) WHERE k = 1),
w AS (SELECT fold_id, instrument, CASE WHEN state = 'stress' THEN p ELSE 1 - p END AS share FROM b JOIN s USING (fold_id)),
x AS (SELECT fold_id, instrument, CASE WHEN sum(share) OVER (PARTITION BY fold_id) > 0 THEN share / sum(share) OVER (PARTITION BY fold_id) ELSE 1.0 / count(*) OVER (PARTITION BY fold_id) END AS weight FROM w)
SELECT fold_id, instrument, round(sum(weight), 6) + 0.0 AS weight FROM x GROUP BY ALL""")
def regime_blended_weights(spark, sf):
    f = rolling(spark, sf)
    at = rg.as_of(f.select(F.col("signal").alias("date")), regimes(spark, sf)).join(f.select("fold_id", F.col("signal").alias("date")), "date")
    done = rg.blended_best(train(spark, sf), weekly_states(spark, sf), at)
    return done.withColumn("weight", rounded(F.col("weight")))


view("state_rows", "SELECT fold_id, state, date, instrument, ret FROM train JOIN state_asof USING (date) WHERE state IS NOT NULL")
view("state_share", """SELECT fold_id, state, CASE WHEN sum(share) OVER (PARTITION BY fold_id) > 0 THEN share / sum(share) OVER (PARTITION BY fold_id) ELSE 1.0 / count(*) OVER (PARTITION BY fold_id) END AS share FROM (
  SELECT fold_id, state, CASE WHEN state = 'stress' THEN p ELSE 1 - p END AS share FROM (SELECT fold_id, state FROM state_rows GROUP BY ALL HAVING count(DISTINCT date) >= 3) JOIN (SELECT f.fold_id, r.p FROM folds_r f ASOF JOIN regimes r ON f.signal >= r.date) USING (fold_id))""")
view("state_w", fill_sql("(SELECT fold_id, state, instrument, avg(ret) AS mu, 0.05 AS lo, 0.5 AS hi FROM state_rows JOIN state_share USING (fold_id, state) GROUP BY ALL)", "fold_id, state", "mu DESC, instrument"))


@query("regime_blended_allocation", "SELECT fold_id, instrument, round(sum(share * weight), 6) + 0.0 AS weight FROM state_w JOIN state_share USING (fold_id, state) GROUP BY ALL")
def regime_blended_allocation(spark, sf):
    """As regime_blended_weights, with a whole allocation within bounds for each state."""
    f, t = rolling(spark, sf), train(spark, sf)
    at = rg.as_of(f.select(F.col("signal").alias("date")), regimes(spark, sf)).join(f.select("fold_id", F.col("signal").alias("date")), "date")
    limits = t.select("instrument").distinct().withColumns({"lo": F.lit(0.05), "hi": F.lit(0.5)})
    return rg.blended(t, weekly_states(spark, sf), at, limits, by_mean_return).withColumn("weight", rounded(F.col("weight")))


view("event_folds", "SELECT date AS signal, coalesce(lead(date) OVER (ORDER BY date), DATE '9999-12-31') AS until, row_number() OVER (ORDER BY date) AS fold_id FROM switches")
view("event_hold", "SELECT fold_id, v.date, instrument, ret FROM type_valuation v JOIN event_folds f ON v.date > f.signal AND v.date <= f.until")


@query("event_rebalance_returns", f"""WITH t AS (SELECT DISTINCT fold_id, instrument, 1.0 / 6 AS weight FROM event_hold),
g AS (SELECT fold_id, date, instrument, product(1 + ret) OVER (PARTITION BY fold_id, instrument ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM event_hold),
v AS (SELECT fold_id, date, 1 + sum((g - 1) / 6) AS v FROM g GROUP BY ALL)
SELECT fold_id, date, round(v / coalesce(lag(v) OVER (PARTITION BY fold_id ORDER BY date), 1) - 1, 8) + 0.0 AS ret FROM v""")
def event_rebalance_returns(spark, sf):
    from arborfolio.operators.folds import holding_days

    order = Window.orderBy("date")
    switch = rg.transitions(regimes(spark, sf)).select(F.col("date").alias("signal"), F.lead("date").over(order).alias("next_signal"), F.row_number().over(order).alias("fold_id"))
    v = valuation(spark, sf)
    rows = holding_days(v, switch).join(switch.select("signal", "fold_id"), "signal").join(v, "date").select("fold_id", "date", "instrument", "ret")
    targets = rows.select("fold_id", "instrument").distinct().select("fold_id", F.lit("EVENT").alias("arm"), "instrument", F.lit(1 / 6).alias("weight"))
    return le.ledger_returns(le.growth(targets, rows)).select("fold_id", "date", rounded(F.col("ret"), 8).alias("ret"))


@query("lagged_switch_returns", """SELECT date, round(CASE before WHEN 'stress' THEN s WHEN 'calm' THEN c END, 8) + 0.0 AS ret FROM (SELECT date, s, c, lag(state) OVER (ORDER BY date) AS before FROM (
  SELECT date, max(CASE WHEN instrument = 'ticker:ECONOMY' THEN ret END) AS s, max(CASE WHEN instrument = 'ticker:PROMO' THEN ret END) AS c FROM type_valuation GROUP BY 1) JOIN regimes USING (date))""")
def lagged_switch_returns(spark, sf):
    return rg.lagged_switch(valuation(spark, sf), regimes(spark, sf), "ticker:ECONOMY", "ticker:PROMO").withColumn("ret", rounded(F.col("ret"), 8))


# Streams over the events

view("running", "SELECT user_id AS job FROM events GROUP BY 1 HAVING arg_max(event_type, (ts, event_id)) <> 'purchase'")
STALE = "SELECT job, heartbeat FROM (SELECT user_id AS job, max(ts) AS heartbeat FROM events GROUP BY 1) WHERE job IN (SELECT job FROM running) AND heartbeat < (SELECT max(ts) FROM events) - INTERVAL 12 HOURS"


def _running(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("job")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last")).where("last <> 'purchase'").select("job")


@query("stale_jobs", STALE)
def stale_jobs(spark, sf):
    beats = table(spark, sf, "events").groupBy(F.col("user_id").alias("job")).agg(F.max("ts").alias("heartbeat"))
    return jobs.stale(beats, _running(spark, sf), "12 HOURS")


@query("stream_stale_jobs", STALE)
def stream_stale_jobs(spark, sf):
    feed = jobs.arriving(spark, f"{sf}/events.parquet").select(F.col("user_id").alias("job"), "ts")
    return jobs.stale(jobs.last_heartbeats(feed), _running(spark, sf), "12 HOURS")


@query("stream_period_returns", "SELECT CAST(time_bucket(INTERVAL 7 DAYS, ts, TIMESTAMP '1970-01-03') + INTERVAL 6 DAYS AS DATE) AS week_end, event_type AS instrument, round(product(1 + value / 100000) - 1, 6) + 0.0 AS ret FROM events GROUP BY 1, 2")
def stream_period_returns(spark, sf):
    feed = jobs.arriving(spark, f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("instrument"), (F.col("value") / 100000).alias("ret"))
    return jobs.period_returns(feed).withColumn("ret", rounded(F.col("ret")))


@query("stream_transitions", "SELECT user_id AS key, ts, before, event_type AS state FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR before <> event_type")
def stream_transitions(spark, sf):
    feed = jobs.arriving(spark, f"{sf}/events.parquet").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("event_type").alias("state"))
    return jobs.transitions(feed)
