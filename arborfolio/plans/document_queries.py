"""Queries on nested documents: hashes of order books and tables of saved trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborfolio.operators import documents as do
from arborfolio.operators import node_rules as nr
from arborfolio.plans.registry import query, view
from arborfolio.sources.prices import table
from arborfolio.sources.written import shared


def books(spark, sf):
    """One document for each customer with orders, its orders in a nested list; every 50th text is cut off."""
    line = F.struct(F.col("o_totalprice").alias("total"), F.col("o_orderkey").alias("key"), F.struct(F.col("o_orderstatus").alias("status"), F.array().cast("array<string>").alias("notes")).alias("state"))
    orders = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", line.alias("line")))), lambda x: x["line"]).alias("orders"))
    body = F.to_json(F.struct(F.lit(True).alias("open"), "orders", "id"), {"pretty": "true"})
    return orders.select("id", F.when(F.col("id") % 50 == 7, F.substring(body, 1, 20)).otherwise(body).alias("body"))


BOOKS_SQL = """SELECT o_custkey AS id, CASE WHEN o_custkey % 50 <> 7 THEN '{"id":' || o_custkey || ',"open":true,"orders":[' || string_agg('{"key":' || o_orderkey || ',"state":{"notes":[],"status":"' || o_orderstatus || '"},"total":' || CAST(CAST(o_totalprice AS DOUBLE) AS VARCHAR) || '}', ',' ORDER BY o_orderkey) || ']}' END AS text FROM orders GROUP BY 1"""


@query("nested_content_hash", f"SELECT id, 'sha256:' || sha256(text) AS hash, CASE WHEN text IS NULL THEN 'malformed' END AS problem FROM ({BOOKS_SQL})")
def nested_content_hash(spark, sf):
    return do.canonical_documents(books(spark, sf)).select("id", "hash", "problem")


# Saved trees of three levels, one for each customer: root over A, A over B; bounds, views and the benchmark vary with the customer

view("saved_in", "SELECT c_custkey AS tree_id, c_custkey % 3 AS m, CASE WHEN c_custkey % 4 = 0 THEN 0.5 END AS cap, (c_custkey % 5) / 10.0 AS lo, CASE WHEN c_custkey % 2 = 0 THEN 0.7 END AS hi, c_custkey % 30 <> 11 AS whole FROM customer")


@shared
def saved_trees(spark, sf):
    k = F.col("c_custkey")
    one = lambda name, value: F.create_map(F.lit(name), value)
    views = F.when(k % 3 == 1, F.array(F.struct(F.create_map(F.lit("x"), F.lit(1.0), F.lit("TICKER:y"), F.lit(-1.0)).alias("instruments"), F.lit(0.02).alias("expected_return"), F.lit(0.5).alias("confidence"))))
    rules = F.struct(one("gld", (k % 5) / 10).alias("min_weights"), F.when(k % 2 == 0, one("ticker:GLD", F.lit(0.7))).alias("max_weights"), F.when(k % 4 == 0, 0.5).alias("per_asset_cap"), views.alias("views"))
    bare = F.struct(F.create_map().cast("map<string,double>").alias("min_weights"))
    node = lambda i, held, below, proxy, c: F.struct(F.lit(i).alias("id"), F.array(*map(F.lit, held)).alias("instruments"), F.array(*map(F.lit, below)).cast("array<string>").alias("children"), F.lit(proxy).cast("string").alias("proxy"), c.alias("constraints"))
    whole = lambda n: F.from_json(F.to_json(n), "id STRING, instruments ARRAY<STRING>, children ARRAY<STRING>, proxy STRING, constraints STRUCT<min_weights: MAP<STRING, DOUBLE>, max_weights: MAP<STRING, DOUBLE>, per_asset_cap: DOUBLE, views: ARRAY<STRUCT<instruments: MAP<STRING, DOUBLE>, expected_return: DOUBLE, confidence: DOUBLE>>>")
    nodes = F.array(whole(node("R", ["gld ", "x"], ["A"], None, rules)), whole(node("A", ["y"], ["B"], "spy", bare)), whole(node("B", ["z"], [], "agg", bare)))
    body = F.to_json(F.struct(F.lit("R").alias("root_id"), nodes.alias("nodes"), F.struct(F.create_map(F.lit("spy"), F.lit(0.6), F.lit("agg"), F.lit(0.4)).alias("weights")).alias("benchmark")))
    return table(spark, sf, "customer").select(k.alias("tree_id"), F.when(k % 30 == 11, F.lit("{")).otherwise(body).alias("body"))


@query("saved_tree_tables", """SELECT tree_id, 'bound' AS kind, node_id, instrument, round(CASE WHEN instrument = 'ticker:GLD' THEN lo ELSE 0 END, 6) AS a, round(least(CASE WHEN instrument = 'ticker:GLD' THEN coalesce(hi, 1) ELSE 1 END, CASE WHEN node_id = 'R' THEN coalesce(cap, 1) ELSE 1 END), 6) AS b
    FROM saved_in CROSS JOIN (VALUES ('R', 'ticker:GLD'), ('R', 'ticker:X'), ('A', 'ticker:Y'), ('B', 'ticker:Z')) i(node_id, instrument) WHERE whole
  UNION ALL SELECT tree_id, 'edge', node_id, child, NULL, NULL FROM saved_in CROSS JOIN (VALUES ('R', 'A'), ('A', 'B')) e(node_id, child) WHERE whole
  UNION ALL SELECT tree_id, 'view', 'R', instrument, coef, 0.5 FROM saved_in CROSS JOIN (VALUES ('ticker:X', 1.0), ('ticker:Y', -1.0)) v(instrument, coef) WHERE whole AND m = 1
  UNION ALL SELECT tree_id, 'benchmark', NULL, instrument, weight, NULL FROM saved_in CROSS JOIN (VALUES ('ticker:SPY', 0.6), ('ticker:AGG', 0.4)) w(instrument, weight) WHERE whole
  UNION ALL SELECT tree_id, 'node', node_id, proxy, NULL, NULL FROM saved_in CROSS JOIN (VALUES ('R', NULL), ('A', 'ticker:SPY'), ('B', 'ticker:AGG')) n(node_id, proxy) WHERE whole
  UNION ALL SELECT tree_id, 'broken', NULL, NULL, NULL, NULL FROM saved_in WHERE NOT whole""")
def saved_tree_tables(spark, sf):
    t = do.tree_tables(saved_trees(spark, sf))
    none, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    row = lambda name, kind, node, instrument, a=none, b=none: t[name].select("tree_id", F.lit(kind).alias("kind"), node.alias("node_id"), instrument.alias("instrument"), F.round(a, 6).alias("a"), F.round(b, 6).alias("b"))
    c = F.col
    out = row("bounds", "bound", c("node_id"), c("instrument"), c("lo"), c("hi"))
    for more in (row("edges", "edge", c("parent_id"), c("child_id")), row("views", "view", c("node_id"), c("instrument"), c("coef"), c("confidence")), row("benchmark", "benchmark", text, c("instrument"), c("weight")), row("nodes", "node", c("node_id"), c("proxy")), row("broken", "broken", text, text)):
        out = out.unionByName(more)
    return out


# Trees of a root R and a node N, one for each customer, whose spread is the account's balance; a sixtieth of the customers has each fault

#: Customer number modulo 60: the node, what its constraints hold, and the rule broken with its message.
FAULTS = {
    1: ("N", '"min_weights": {"A": 0.6}, "max_weights": {"A": 0.5}', "crossed bounds", "a least weight exceeds its highest"),
    2: ("R", '"max_weights": {"A": 1.5}', "max_weights range", "max_weights must lie in [0, 1]"),
    3: ("N", '"min_weights": [0.1]', "min_weights kind", "min_weights must be an object"),
    4: ("N", '"vol_target": "much"', "vol_target not finite", "vol_target must be a finite number"),
    5: ("R", '"risk_aversion": NaN', "risk_aversion not finite", "risk_aversion must be a finite number"),
    6: ("N", '"view_tau": 0', "view_tau", "view_tau must be positive"),
    7: ("N", '"max_tracking_error": -0.01', "max_tracking_error negative", "max_tracking_error must not be negative"),
    8: ("R", '"per_asset_cap": "1.25"', "asset cap", "per_asset_cap must not exceed one"),
    9: ("N", '"max_turnover": 0.2', "turnover", "no rule limits turnover"),
    11: ("N", '"covariance_estimator": "oas"', "covariance_estimator", "covariance_estimator is none of the known ones: oas"),
    12: ("N", '"volatility_reference": "current_root_synthetic"', "reserved reference", "a reference is kept for a mode that does not exist yet"),
    13: ("R", '"mean_reference_kind": "local_weights"', "reference weights missing", "local_weights needs mean_reference_weights"),
    14: ("R", '"mean_reference_kind": "local_weights", "mean_reference_weights": {"A": 0.5, "B": 0.25}', "reference weights sum", "mean_reference_weights must sum to one"),
    16: ("N", '"mean_reference_weights": {"A": 1.0}', "reference weights unused", "mean_reference_weights needs local_weights"),
    17: ("N", '"volatility_target_mode": "cap", "vol_target": 0.1, "max_volatility": 0.2', "two caps", "cap mode takes vol_target or max_volatility, not both"),
    18: ("N", '"views": {"A": 1}', "views kind", "views must be a list"),
    19: ("N", '"views": [7]', "view kind", "a view must be an object"),
    21: ("R", '"views": [{"expected_return": 0.01, "confidence": 1.5, "instruments": {"A": 1}}]', "view confidence", "a view's confidence must lie in (0, 1]"),
    22: ("R", '"views": [{"expected_return": 0.01, "confidence": 0.5, "instruments": {}}]', "view without coefficients", "a view needs coefficients"),
    23: ("N", '"views": [{"expected_return": 0.01, "confidence": 0.5, "instruments": {" CASH:RF": 1}}]', "view on financing", "a view must not name a financing leg"),
    24: ("N", '"views": [{"expected_return": 0.01, "confidence": 0.5, "instruments": {"A": "x"}}]', "view coefficient", "a view's coefficients must be finite numbers"),
    26: ("N", '"views": [{"confidence": 0.5, "instruments": {"A": 1}}]', "view number", "a view needs a finite expected_return and confidence"),
    27: ("N", '"cash_enabled": false, "allow_cash": "yes"', "cash contradiction", "cash_enabled and allow_cash differ"),
    28: ("N", '"volatility_cap_policy": "nearest_feasible"', "volatility_cap_policy", "volatility_cap_policy is none of the known ones: nearest_feasible"),
}
SETTINGS = """c_custkey AS tree_id, c_custkey % 60 AS m, CAST(round(c_acctbal) AS INT) AS bps, c_custkey % 5 = 0 AS cash, CASE WHEN c_nationkey % 3 = 0 THEN 1.0 ELSE 1.5 END AS lever, CASE WHEN c_custkey % 4 = 1 THEN 30 END AS own"""
view("settings_in", f"SELECT {SETTINGS} FROM customer")
view("faults", "SELECT * FROM (VALUES " + ", ".join("({}, '{}', '{}', '{}')".format(m, node, rule, message.replace("'", "''")) for m, (node, _, rule, message) in FAULTS.items()) + ") f(m, node_id, rule, message)")


def settings(spark, sf):
    of = lambda node: F.expr("CASE m " + " ".join(f"WHEN {m} THEN ', {text}'" for m, (n, text, _, _) in FAULTS.items() if n == node) + " ELSE '' END")
    customers = table(spark, sf, "customer").repartition(2 * max(2, spark.sparkContext.defaultParallelism), "c_custkey")  # a small file is few splits, and its trees much work
    rows = customers.selectExpr(*SETTINGS.split(", CASE WHEN c_nationkey")[0].split(", "), "CASE WHEN c_nationkey % 3 = 0 THEN '1.0' ELSE '1.5' END AS lever", "CASE WHEN c_custkey % 4 = 1 THEN 30 END AS own")
    root = F.concat(F.lit('{"id": "R", "constraints": {"risk_free_rate": 0.02'), F.when(F.col("cash"), ', "cash_enabled": true').otherwise(""), of("R"), F.lit("}}"))
    node = F.concat(F.lit('{"id": "N", "goal": {"objective": "max_ratio"}, "constraints": {"max_leverage": '), "lever", F.when(F.col("own").isNotNull(), ', "borrow_spread_bps": "30"').otherwise(""), of("N"), F.lit("}}"))
    body = F.concat(F.lit('{"root_id": "R", "currency": " eur", "data": {"risk_free_annual": 0.02, "borrow_spread_bps": '), F.col("bps").cast("string"), F.lit('}, "nodes": ['), root, F.lit(", "), node, F.lit("]}"))
    return rows.select("tree_id", F.when(F.col("m") == 59, F.substring(body, 1, 50)).otherwise(body).alias("body"))


@query("node_rule_violations", """SELECT tree_id, NULL AS node_id, 'malformed' AS rule, 'the text is no JSON object' AS message FROM settings_in WHERE m = 59
  UNION ALL SELECT tree_id, NULL, 'data spread', 'data.borrow_spread_bps must not be negative' FROM settings_in WHERE m <> 59 AND bps < 0
  UNION ALL SELECT tree_id, NULL, 'spread without any financing', 'a spread is stated, but no node lends or borrows' FROM settings_in WHERE m <> 59 AND bps > 0 AND NOT cash AND lever = 1
  UNION ALL SELECT tree_id, 'R', 'spread', 'borrow_spread_bps must not be negative' FROM settings_in WHERE m <> 59 AND bps < 0 AND cash
  UNION ALL SELECT tree_id, 'N', 'spread', 'borrow_spread_bps must not be negative' FROM settings_in WHERE m <> 59 AND bps < 0 AND lever > 1 AND own IS NULL
  UNION ALL SELECT tree_id, 'N', 'spread without financing', 'borrow_spread_bps needs cash or leverage above one' FROM settings_in WHERE m <> 59 AND own > 0 AND lever = 1
  UNION ALL SELECT tree_id, node_id, rule, message FROM settings_in JOIN faults USING (m)""")
def node_rule_violations(spark, sf):
    return nr.node_violations(settings(spark, sf))


@query("node_financing", """SELECT tree_id, 'R' AS node_id, cash AS cash_enabled, 1.0::DOUBLE AS max_leverage, CASE WHEN cash THEN bps ELSE 0 END::DOUBLE AS spread, CASE WHEN cash THEN 'node' ELSE 'default' END AS cash_source, 'default' AS leverage_source, CASE WHEN cash THEN 'root' ELSE 'default' END AS spread_source FROM settings_in WHERE m <> 59
  UNION ALL SELECT tree_id, 'N', lever > 1, lever, CASE WHEN own IS NOT NULL THEN own WHEN lever > 1 THEN bps ELSE 0 END, CASE WHEN lever > 1 OR m = 27 THEN 'node' ELSE 'default' END, 'node', CASE WHEN own IS NOT NULL THEN 'node' WHEN lever > 1 THEN 'root' ELSE 'default' END FROM settings_in WHERE m <> 59""")
def node_financing(spark, sf):
    return nr.node_financing(settings(spark, sf))
