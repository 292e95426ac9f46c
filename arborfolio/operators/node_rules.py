"""Saved trees held to the rules of their settings, and the financing that nodes inherit.

Every rule reads one document, so all of it is one pass without a shuffle: what a node takes from its
root is looked up in the document's own array before the nodes are exploded. Fields are read as texts
first, so that a wrong kind, a number that is not finite and a missing field can be told apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborfolio.operators.catalog import CHOICES, LIMITS, OBJECTIVES, RESERVED

NUMBERS = ("risk_aversion", "risk_free_rate", "view_tau", *LIMITS, "max_leverage", "borrow_spread_bps")
REFERENCES = ("volatility_reference", "max_volatility_reference", "tracking_error_reference", "mean_reference_kind")
WEIGHTS = ("min_weights", "max_weights", "mean_reference_weights")
FIELDS = (*NUMBERS, *REFERENCES[:3], *WEIGHTS, *(c for c in CHOICES if c != "currency"), "maximum_turnover", "max_turnover", "cash_enabled", "allow_cash", "views")
CONSTRAINTS = ", ".join(f"{f} STRING" for f in FIELDS)
#: What a switch may hold.
ON, OFF = ("1", "1.0", "true", "True", "yes", "on"), ("", "0", "0.0", "false", "False", "no", "off")


def _stated(c: Column) -> Column:
    """A text that is neither missing nor empty, else null."""
    return F.when(c != "", c)


def _number(c: Column) -> Column:
    """The number in a text; a type suffix (1d, 1f), which the cast would take, makes it none."""
    return F.when(~c.rlike(r"[dDfF]\s*$"), _stated(c).try_cast("double"))


def _not_finite(c: Column) -> Column:
    """Stated, but no number that a double holds."""
    value = _number(c)
    return _stated(c).isNotNull() & (value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")))


def _finite(c: Column) -> Column:
    return F.when(~_not_finite(c), _number(c))


def _object(c: Column, of: str = "MAP<STRING, STRING>") -> Column:
    """The object in a text, null if it is another kind of value."""
    return F.when(F.trim(c).startswith("{"), F.from_json(c, of))


def _list(c: Column) -> Column:
    return F.when(F.trim(c).startswith("["), F.from_json(c, "ARRAY<STRING>"))


def _switch(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).isin(*ON)


def _financing(of: Column) -> Column:
    """Whether the constraints ``of`` a node let it hold cash or borrow."""
    return _switch(F.coalesce(of["cash_enabled"], of["allow_cash"])) | (F.coalesce(_finite(of["max_leverage"]), F.lit(1.0)) > 1)


def tree_nodes(documents: DataFrame) -> DataFrame:
    """A row a node of the trees (tree_id, body), a document without a list of nodes as one row without a node.

    Columns: tree_id, readable, pos, root_id, currency, data_text, rate, spread (texts of the tree's ``data``), node_text, node_id,
    objective, constraints_text, c (the node's constraints), root (the root's), is_root, financed (any node), has_root, has_data, has_nodes.
    """
    form = "root_id STRING, currency STRING, data STRING, nodes STRING, unread STRING"
    doc = documents.select("tree_id", F.col("body").alias("__body"), F.from_json("body", form, {"columnNameOfCorruptRecord": "unread"}).alias("d"))
    readable = F.coalesce(F.trim("__body").startswith("{") & F.col("d.unread").isNull() & F.col("d").isNotNull(), F.lit(False))
    doc = doc.select("tree_id", readable.alias("readable"), "d.root_id", "d.currency", F.col("d.data").alias("data_text"), _object(F.col("d.data")).alias("data"), _list(F.col("d.nodes")).alias("nodes"))
    part = lambda t: _object(t, "id STRING, goal STRING, constraints STRING")
    known = F.transform("nodes", lambda t: F.struct(t.alias("text"), part(t).alias("n")))
    doc = doc.withColumn("known", known)
    full = lambda n: F.struct(n["text"].alias("text"), F.coalesce(n["n"]["id"], F.lit("<unknown>")).alias("id"), _object(n["n"]["goal"], "objective STRING")["objective"].alias("objective"), n["n"]["constraints"].alias("stated"), F.coalesce(_object(n["n"]["constraints"], CONSTRAINTS), F.from_json(F.lit("{}"), CONSTRAINTS)).alias("c"))
    doc = doc.withColumn("known", F.transform("known", full))
    top = F.filter("known", lambda n: n["id"] == F.col("root_id"))
    doc = doc.withColumns({"top": F.try_element_at(top, F.lit(1)), "financed": F.exists("known", lambda n: _financing(n["c"]))})
    rows = doc.select("tree_id", "readable", "root_id", "currency", "data_text", "data", "nodes", "top", "financed", F.posexplode_outer("known").alias("pos", "k"))
    return rows.select(
        "tree_id", "readable", "root_id", "currency", "data_text", F.col("data").isNotNull().alias("has_data"), F.try_element_at("data", F.lit("risk_free_annual")).alias("rate"), F.try_element_at("data", F.lit("borrow_spread_bps")).alias("spread"),
        F.col("nodes").isNotNull().alias("has_nodes"), "pos", F.col("k.text").alias("node_text"), F.col("k.id").alias("node_id"), F.col("k.objective").alias("objective"), F.col("k.stated").alias("constraints_text"), F.col("k.c").alias("c"),
        F.col("top.c").alias("root"), (F.col("k.id") == F.col("root_id")).alias("is_root"), F.coalesce("financed", F.lit(False)).alias("financed"), F.col("top").isNotNull().alias("has_root"),
    )


def _root_spread() -> tuple[Column, Column]:
    """The tree's spread in basis points and whence it comes: the root's own, else the tree's data, else none."""
    own, shared = _finite(F.col("root.borrow_spread_bps")), _finite(F.col("spread"))
    return F.coalesce(own, shared, F.lit(0.0)), F.when(own.isNotNull(), "node").when(shared.isNotNull(), "root").otherwise("default")


def _spread() -> tuple[Column, Column]:
    """A node's spread and its source. A node that can neither lend nor borrow inherits none."""
    own, on = _finite(F.col("c.borrow_spread_bps")), _financing(F.col("c"))
    top, source = _root_spread()
    idle_root = F.col("is_root") & ~on
    value = F.when(own.isNotNull(), F.when(idle_root, 0.0).otherwise(own)).when(on, top).otherwise(0.0)
    whence = F.when(own.isNotNull(), F.when(idle_root, "default").otherwise("node")).when(on & F.col("is_root"), source).when(on & (source != "default"), "root").otherwise("default")
    return value, whence


def node_financing(documents: DataFrame) -> DataFrame:
    """(tree_id, node_id, cash_enabled, max_leverage, spread, cash_source, leverage_source, spread_source) of each node.

    Leverage above one brings cash with it. Fields that break a rule count as not stated.
    """
    value, whence = _spread()
    lever = _finite(F.col("c.max_leverage"))
    told = F.col("c.cash_enabled").isNotNull() | F.col("c.allow_cash").isNotNull() | (F.coalesce(lever, F.lit(1.0)) > 1)
    source = lambda stated: F.when(stated, "node").otherwise("default")
    nodes = tree_nodes(documents).where("node_id IS NOT NULL")
    return nodes.select("tree_id", "node_id", _financing(F.col("c")).alias("cash_enabled"), F.coalesce(lever, F.lit(1.0)).alias("max_leverage"), value.alias("spread"), source(told).alias("cash_source"), source(lever.isNotNull()).alias("leverage_source"), whence.alias("spread_source"))


def node_violations(documents: DataFrame) -> DataFrame:
    """(tree_id, node_id, rule, message) for every rule that a document or one of its nodes breaks; node_id is null for a document's.

    All broken rules are named, not just the first; a field that is no finite number is only named as that.
    """
    c = lambda name: F.col(f"c.{name}")
    say = lambda test, rule, message: F.when(test, F.struct(F.lit(rule).alias("rule"), (message if isinstance(message, Column) else F.lit(message)).alias("message")))
    rows = tree_nodes(documents)
    readable, currency = F.col("readable"), F.upper(F.trim("currency"))
    declared, shared = _finite(F.col("root.risk_free_rate")), _finite(F.col("rate"))
    root_spread, _ = _root_spread()
    whole = [
        say(~readable, "malformed", "the text is no JSON object"),
        say(readable & ~F.col("has_nodes"), "nodes", "nodes must be a list"),
        say(readable & F.col("has_nodes") & ~F.col("has_root"), "root missing", "no node has the root's id"),
        say(readable & F.coalesce(currency == "", F.lit(True)), "currency missing", "a tree must name its currency"),
        say(readable & (currency != "") & ~currency.isin(*CHOICES["currency"]), "currency", F.concat(F.lit("currency is none of the known ones: "), "currency")),
        say(readable & (F.col("data_text") != "") & ~F.col("has_data"), "data", "data must be an object"),
        say(_not_finite(F.col("rate")), "data.risk_free_annual", "data.risk_free_annual must be a finite number"),
        say(_not_finite(F.col("spread")), "data.borrow_spread_bps", "data.borrow_spread_bps must be a finite number"),
        say(_finite(F.col("spread")) < 0, "data spread", "data.borrow_spread_bps must not be negative"),
        say(F.abs(declared - shared) > 1e-12, "rate conflict", "the root and the tree's data state different risk-free rates"),
        say((root_spread > 0) & ~F.col("financed"), "spread without any financing", "a spread is stated, but no node lends or borrows"),
    ]
    rows = rows.withColumns({f"__{w}": _object(c(w)) for w in WEIGHTS}).withColumn("__views", _list(c("views")))
    view = "expected_return STRING, confidence STRING, instruments STRING"
    rows = rows.withColumn("__views", F.transform("__views", lambda t: F.struct(_object(t, view).alias("v"), _object(_object(t, view)["instruments"]).alias("on"))))
    entries = lambda w: F.map_entries(f"__{w}")
    any_ = lambda of, test: F.coalesce(F.exists(of, test), F.lit(False))
    local, weights = _choice("mean_reference_kind") == "local_weights", F.map_values("__mean_reference_weights")
    filled = F.coalesce(F.size("__mean_reference_weights") > 0, F.lit(False))
    total = F.aggregate(weights, F.lit(0.0), lambda s, w: s + F.coalesce(_finite(w), F.lit(0.0)))
    label = lambda k: F.lower(F.trim(k))
    kind = lambda name: ~(F.coalesce(c(name), F.lit("")).isin(*ON, *OFF))
    value, _ = _spread()
    view_is = lambda test: any_("__views", test)
    own = [
        say(~F.coalesce(F.trim("node_text").startswith("{"), F.lit(False)), "node", "a node must be an object"),
        say(_stated(F.col("constraints_text")).isNotNull() & ~F.trim("constraints_text").startswith("{"), "constraints", "constraints must be an object"),
        say(~F.coalesce(_stated(F.col("objective")), F.lit(OBJECTIVES[0])).isin(*OBJECTIVES), "objective", F.concat(F.lit("objective is none of the known ones: "), "objective")),
        *(say(~_choice(name).isin(*may), name, F.concat(F.lit(f"{name} is none of the known ones: "), c(name))) for name, may in CHOICES.items() if name != "currency"),
        *(say(_not_finite(c(name)), f"{name} not finite", f"{name} must be a finite number") for name in NUMBERS),
        *(say(_stated(c(w)).isNotNull() & F.col(f"__{w}").isNull(), f"{w} kind", f"{w} must be an object") for w in WEIGHTS),
        *(say(any_(entries(w), lambda e: _not_finite(e["value"])), f"{w} not finite", f"{w} must hold finite numbers") for w in WEIGHTS),
        *(say(any_(entries(w), lambda e: ~_finite(e["value"]).between(0, 1)), f"{w} range", f"{w} must lie in [0, 1]") for w in WEIGHTS[:2]),
        say(any_(entries("min_weights"), lambda e: _finite(e["value"]) > _finite(F.try_element_at("__max_weights", e["key"]))), "crossed bounds", "a least weight exceeds its highest"),
        say(F.coalesce(_stated(c("maximum_turnover")), _stated(c("max_turnover"))).isNotNull(), "turnover", "no rule limits turnover"),
        say(F.exists(F.array(*(c(r) for r in REFERENCES)), lambda r: r.isin(*RESERVED)), "reserved reference", "a reference is kept for a mode that does not exist yet"),
        say(local & ~filled, "reference weights missing", "local_weights needs mean_reference_weights"),
        say(local & filled & (F.abs(total - 1) > 1e-6), "reference weights sum", "mean_reference_weights must sum to one"),
        say(~local & filled, "reference weights unused", "mean_reference_weights needs local_weights"),
        *(say(_finite(c(n)) <= 0, n, f"{n} must be positive") for n in ("risk_aversion", "view_tau")),
        *(say(_finite(c(n)) < 0, f"{n} negative", f"{n} must not be negative") for n in LIMITS),
        say(_finite(c("per_asset_cap")) > 1, "asset cap", "per_asset_cap must not exceed one"),
        say(_stated(c("views")).isNotNull() & F.col("__views").isNull(), "views kind", "views must be a list"),
        say(view_is(lambda v: v["v"].isNull()), "view kind", "a view must be an object"),
        say(view_is(lambda v: v["v"].isNotNull() & (_finite(v["v"]["expected_return"]).isNull() | _finite(v["v"]["confidence"]).isNull())), "view number", "a view needs a finite expected_return and confidence"),
        say(view_is(lambda v: (_finite(v["v"]["confidence"]) <= 0) | (_finite(v["v"]["confidence"]) > 1)), "view confidence", "a view's confidence must lie in (0, 1]"),
        say(view_is(lambda v: v["v"].isNotNull() & (F.coalesce(F.size(v["on"]), F.lit(0)) <= 0)), "view without coefficients", "a view needs coefficients"),
        say(view_is(lambda v: any_(F.map_keys(v["on"]), lambda k: label(k).startswith("cash:rf") | label(k).startswith("cash:borrow"))), "view on financing", "a view must not name a financing leg"),
        say(view_is(lambda v: any_(F.map_values(v["on"]), lambda x: _not_finite(F.coalesce(x, F.lit("null"))))), "view coefficient", "a view's coefficients must be finite numbers"),
        say(_choice("volatility_target_mode").isin("cap", "at_most") & _stated(c("vol_target")).isNotNull() & _stated(c("max_volatility")).isNotNull(), "two caps", "cap mode takes vol_target or max_volatility, not both"),
        say(_finite(c("max_leverage")) < 1, "leverage", "max_leverage must be at least one"),
        say(kind("cash_enabled") | kind("allow_cash"), "cash kind", "cash_enabled must be true or false"),
        say(c("cash_enabled").isNotNull() & c("allow_cash").isNotNull() & (_switch(c("cash_enabled")) != _switch(c("allow_cash"))), "cash contradiction", "cash_enabled and allow_cash differ"),
        say(value < 0, "spread", "borrow_spread_bps must not be negative"),
        say((value > 0) & ~_financing(F.col("c")), "spread without financing", "borrow_spread_bps needs cash or leverage above one"),
    ]
    found = lambda tests, node: F.transform(F.array_compact(F.array(*tests)), lambda x: F.struct(node.alias("node_id"), x["rule"].alias("rule"), x["message"].alias("message")))
    none = F.array().cast("array<struct<node_id: string, rule: string, message: string>>")
    first = F.when(F.coalesce("pos", F.lit(0)) == 0, found(whole, F.lit(None).cast("string")))  # a document's own rules go with its first node
    every = F.concat(F.coalesce(first, none), F.coalesce(F.when(F.col("node_id").isNotNull(), found(own, F.col("node_id"))), none))
    return rows.select("tree_id", F.explode(every).alias("b")).select("tree_id", "b.node_id", "b.rule", "b.message")


def _choice(name: str) -> Column:
    return F.coalesce(_stated(F.col(f"c.{name}")), F.lit(CHOICES[name][0]))
