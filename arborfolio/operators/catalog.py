"""Catalog searches, config tables, their rules, and run and revision histories."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from arborfolio.sources.written import grow, shared_dir

#: A node's config as JSON; fields of CHOICES and LIMITS are read beside these.
CONFIG = """node_id STRING, objective STRING, leverage DOUBLE, spread DOUBLE, confidence DOUBLE, min_weights MAP<STRING, DOUBLE>, max_weights MAP<STRING, DOUBLE>,
  mean_reference_weights MAP<STRING, DOUBLE>, maximum_turnover DOUBLE, max_turnover DOUBLE, cash_enabled BOOLEAN, allow_cash BOOLEAN, risk_aversion DOUBLE, view_tau DOUBLE,
  volatility_reference STRING, max_volatility_reference STRING, tracking_error_reference STRING, views ARRAY<STRUCT<confidence: DOUBLE, coefficients: MAP<STRING, DOUBLE>>>"""
OBJECTIVES = ("min_risk", "max_return", "max_ratio", "max_utility", "hrp")
#: What each of these fields may hold; the first is the default.
CHOICES = {
    "covariance_estimator": ("shrunk_fixed", "ledoit_wolf"),
    "view_covariance_policy": ("prior_risk", "posterior_all"),
    "volatility_target_mode": ("exact", "cap", "at_most"),
    "mean_reference_kind": ("none", "benchmark", "local_weights"),
    "tracking_error_policy": ("hard_fail", "nearest_feasible"),
    "volatility_target_policy": ("hard_fail", "nearest_feasible"),
    "volatility_cap_policy": ("hard_fail",),
    "currency": ("USD", "EUR", "GBP", "JPY"),
}
#: References kept for a mode that does not exist yet.
RESERVED = ("current_parent_synthetic", "current_root_synthetic")
LIMITS = ("per_asset_cap", "vol_target", "max_volatility", "max_tracking_error")
#: The fields that a search looks into.
SEARCHED = ("symbol", "name", "asset_class", "area", "category", "sub_group", "sector", "theme")
#: Parts of key names whose values are secrets.
SECRET_WORDS = ("token", "secret", "password", "api_key", "apikey")
#: What counts as an e-mail address, a phone number and a long run of digits.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?<!\d)(?:\+\d{1,3}[ .\-]?|\d{1,3}[ .\-])?\(?\d{3}\)?[ .\-]?\d{3}[ .\-]?\d{4}(?!\d)"
DIGITS = r"(?<!\d)\d{9,}(?!\d)"


def normalized_symbols(names: DataFrame, column: str = "name") -> DataFrame:
    """(symbol): prefix off, trimmed, in capitals, distinct; empty ones go."""
    bare = F.upper(F.trim(F.regexp_replace(F.trim(column), "^(?i)ticker:", "")))
    return names.select(bare.alias("symbol")).where("symbol <> ''").distinct()


def search(listings: DataFrame, instruments: DataFrame, classes: DataFrame, coverage: DataFrame, text: str, least: int = 0, start_before: str | None = None, limit: int = 100) -> DataFrame:
    """At most ``limit`` (1 to 100) listings in trade with what is known of them; the exact symbol first, then by symbol and exchange.

    ``listings`` (symbol, exchange, active_to), ``instruments`` (symbol, name, kind), ``classes`` (symbol in any case, and the
    other SEARCHED fields), ``coverage`` (symbol, observations, first_date, last_date). Any of the SEARCHED fields may be
    LIKE the text, in any case. ``least``: observations that a listing must have; ``start_before``: a day by which its prices
    must have begun. A text of less than two characters finds nothing unless one of these is given.
    """
    classes = classes.withColumn("__upper", F.upper("symbol")).drop("symbol")
    known = listings.where("active_to IS NULL").join(instruments, "symbol").join(coverage, "symbol", "left")
    joined = known.join(classes, F.upper(known["symbol"]) == classes["__upper"], "left").drop("__upper").fillna(0, ["observations"])
    text = text.strip().upper()
    like = F.exists(F.array(*(F.upper(F.col(c).cast("string")) for c in SEARCHED)), lambda field: F.coalesce(field, F.lit("")).like(f"%{text}%"))
    found = joined.where(like & (F.col("observations") >= least))
    if start_before:
        found = found.where(F.col("first_date") <= F.lit(start_before).cast("date"))
    if len(text) < 2 and least <= 0 and not start_before:
        found = found.where(F.lit(False))
    return found.orderBy((F.upper("symbol") != text).cast("int"), "symbol", "exchange").limit(max(1, min(limit, 100)))


def fingerprint(coverage: DataFrame) -> DataFrame:
    """One row: sha256 over the sorted (symbol, last_date, count) lines, and the latest day; sentinels if empty."""
    line = F.concat_ws("|", "symbol", F.col("last_date").cast("string"), F.col("observations").cast("string"))
    lines = F.sort_array(F.collect_list(line))
    return coverage.agg(
        F.when(F.count("*") == 0, "empty").otherwise(F.sha2(F.concat_ws("\n", lines), 256)).alias("fingerprint"), F.coalesce(F.max("last_date").cast("string"), F.lit("none")).alias("as_of")
    )


def fingerprints(universes: DataFrame, coverage: DataFrame) -> DataFrame:
    """(tree_id, as_of, fingerprint): for each tree the latest covered day and a sha256 over its symbols' coverage.

    ``universes`` (tree_id, instrument): a tree's instruments, null for a tree without any; ``coverage`` (symbol, last_date,
    observations, run). What is hashed is a JSON list of [symbol, day, count, run] as texts, by symbol as stored. A tree without
    instruments has the fingerprint no-instruments, one of which no symbol is covered no-coverage; both have no day.
    Only the lines of one tree are held together.
    """
    symbol = F.upper(F.trim(F.regexp_replace("instrument", "^[^:]*:", ""))).alias("symbol")
    symbols = universes.select("tree_id", symbol).distinct()
    texts = F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in ("symbol", "last_date", "observations", "run")))
    lines = coverage.select(F.upper("symbol").alias("symbol"), F.col("last_date").cast("string").alias("day"), F.struct("symbol", F.to_json(texts).alias("text")).alias("line"))
    joined = symbols.join(lines, "symbol", "left").groupBy("tree_id")
    grouped = joined.agg(F.count("symbol").alias("n"), F.max("day").alias("as_of"), F.sort_array(F.collect_list("line"))["text"].alias("texts"))
    whole = F.concat(F.lit("["), F.concat_ws(",", "texts"), F.lit("]"))
    told = F.when(F.col("n") == 0, "no-instruments").when(F.size("texts") == 0, "no-coverage").otherwise(F.sha2(whole, 256))
    return grouped.select("tree_id", "as_of", told.alias("fingerprint"))


def parse_configs(configs: DataFrame) -> DataFrame:
    """Config texts (tree_id, body) as rows with defaults; a text that does not parse has a null node_id."""
    fields = ", ".join([CONFIG, *(f"{c} STRING" for c in CHOICES), *(f"{c} DOUBLE" for c in LIMITS)])
    defaults = {"objective": OBJECTIVES[0], "leverage": 1.0, "spread": 0.0, **{c: may[0] for c, may in CHOICES.items()}}
    return configs.select("tree_id", F.from_json("body", fields).alias("c")).select("tree_id", "c.*").fillna(defaults)


def config_bounds(parsed: DataFrame) -> DataFrame:
    """(tree_id, instrument, lo, hi) from both maps."""
    lo = parsed.select("tree_id", F.explode("min_weights").alias("instrument", "lo"))
    hi = parsed.select("tree_id", F.explode("max_weights").alias("instrument", "hi"))
    return lo.join(hi, ["tree_id", "instrument"], "full")


def config_violations(parsed: DataFrame) -> DataFrame:
    """(tree_id, rule) for every rule a config breaks, found in one pass over the configs."""
    c = F.col
    outside = lambda weights: F.exists(F.map_values(weights), lambda w: ~w.between(0, 1))
    some = lambda m: F.coalesce(F.size(m), F.lit(0)) > 0
    local, cash = c("mean_reference_kind") == "local_weights", F.coalesce("cash_enabled", "allow_cash", F.lit(False))
    total = F.aggregate(F.map_values("mean_reference_weights"), F.lit(0.0), lambda s, w: s + w)
    label = lambda name: F.lower(F.trim(name))
    references = F.array("volatility_reference", "max_volatility_reference", "tracking_error_reference", "mean_reference_kind")
    rules = {
        **{field: ~c(field).isin(*may) for field, may in {"objective": OBJECTIVES, **CHOICES}.items()},
        "leverage": c("leverage") < 1,
        "spread": c("spread") < 0,
        "spread without financing": (c("spread") > 0) & (c("leverage") <= 1) & ~cash,
        "confidence": (c("confidence") <= 0) | (c("confidence") > 1),
        "bound range": F.coalesce(outside("min_weights"), F.lit(False)) | F.coalesce(outside("max_weights"), F.lit(False)),
        "crossed bounds": F.exists(F.map_entries("min_weights"), lambda e: e["value"] > F.try_element_at("max_weights", e["key"])),
        "reserved reference": F.exists(references, lambda r: r.isin(*RESERVED)),
        "reference weights missing": local & ~some("mean_reference_weights"),
        "reference weights sum": local & some("mean_reference_weights") & (F.abs(total - 1) > 1e-6),
        "reference weights unused": ~local & some("mean_reference_weights"),
        "turnover": c("maximum_turnover").isNotNull() | c("max_turnover").isNotNull(),
        "risk aversion": c("risk_aversion") <= 0,
        "view tau": c("view_tau") <= 0,
        "negative limit": F.exists(F.array(*LIMITS), lambda x: x < 0),
        "asset cap": c("per_asset_cap") > 1,
        "two caps": c("volatility_target_mode").isin("cap", "at_most") & c("vol_target").isNotNull() & c("max_volatility").isNotNull(),
        "cash contradiction": c("cash_enabled") != c("allow_cash"),
        "view confidence": F.exists("views", lambda v: (v["confidence"] <= 0) | (v["confidence"] > 1)),
        "view without coefficients": F.exists("views", lambda v: F.coalesce(F.size(v["coefficients"]), F.lit(0)) <= 0),
        "view on financing": F.exists("views", lambda v: F.exists(F.map_keys(v["coefficients"]), lambda k: label(k).startswith("cash:rf") | label(k).startswith("cash:borrow"))),
    }
    broken = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in rules.items())))
    return parsed.select("tree_id", F.explode(broken).alias("rule")).distinct()


def tree_violations(nodes: DataFrame, edges: DataFrame, root: str, instruments: DataFrame | None = None) -> DataFrame:
    """(node_id, rule): duplicate ids and names, unknown children, two parents, the root as child, missing,
    shared and colliding proxies, instruments listed twice, nodes out of reach.

    ``nodes`` (node_id, proxy) may have a name, else the id is one; ``instruments`` (node_id, instrument)
    are those a node holds itself. Siblings must have different proxies, none of them an instrument of
    their parent. The walk takes only nodes that it has not met, so it ends on trees of any depth and on
    cycles, whose nodes have a rule of their own.
    """
    say = lambda rows, rule: rows.select("node_id", F.lit(rule).alias("rule")).distinct()
    child = edges.select(F.col("child_id").alias("node_id"), "parent_id")
    inside = edges.join(nodes.select(F.col("node_id").alias("child_id")).distinct(), "child_id", "left_semi").where(F.col("child_id") != root)
    seen = reached(inside, nodes.where(F.col("node_id") == root))
    out = say(nodes.groupBy("node_id").count().where("count > 1"), "duplicate id")
    if "name" in nodes.columns:
        named = nodes.select("node_id", F.coalesce("name", "node_id").alias("name"))
        out = out.unionByName(say(named.join(named.groupBy("name").agg(F.count_distinct("node_id").alias("n")).where("n > 1"), "name"), "duplicate name"))
    proxies = child.join(nodes.where("proxy IS NOT NULL").select("node_id", "proxy").distinct(), "node_id")
    if instruments is not None:
        out = out.unionByName(say(instruments.groupBy("node_id", "instrument").count().where("count > 1"), "duplicate instrument"))
        held = instruments.select(F.col("node_id").alias("parent_id"), F.col("instrument").alias("proxy"))
        out = out.unionByName(say(proxies.join(held, ["parent_id", "proxy"], "left_semi"), "colliding proxy"))
    shared = proxies.groupBy("parent_id", "proxy").agg(F.count_distinct("node_id").alias("n")).where("n > 1")
    for rows, rule in (
        (proxies.join(shared, ["parent_id", "proxy"]), "shared proxy"),
        (child.join(nodes, "node_id", "left_anti"), "unknown child"),
        (child.groupBy("node_id").agg(F.count_distinct("parent_id").alias("n")).where("n > 1"), "two parents"),
        (child.where(F.col("node_id") == root), "root as child"),
        (nodes.where((F.col("node_id") != root) & F.col("proxy").isNull()), "missing proxy"),
        (nodes.join(seen, "node_id", "left_anti"), "unreachable"),
        (in_cycles(edges), "cycle"),
    ):
        out = out.unionByName(say(rows, rule))
    return out


def canonical_json(entries: Column) -> Column:
    """A map of strings as JSON text: keys in order, no spaces, strings escaped, a null value as null."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))), {"ignoreNullFields": "false"})


def content_hash(entries: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(canonical_json(entries), 256))


def redact_keys(entries: Column) -> Column:
    """Values of keys that name a secret become ***."""
    return F.transform_values(entries, lambda k, v: F.when(F.lower(k).rlike("|".join(SECRET_WORDS)), F.lit("***")).otherwise(v))


def redact_pii(text: Column) -> Column:
    """E-mail addresses, then phone numbers, then runs of nine digits and more are masked.

    A phone number has ten digits, whose parts may be set apart, and may follow a country code that
    begins with a plus or is set apart from it.
    """
    text = F.regexp_replace(text, EMAIL, "[redacted-email]")
    text = F.regexp_replace(text, PHONE, "[redacted-phone]")
    return F.regexp_replace(text, DIGITS, "[redacted-number]")


def illegal_transitions(history: DataFrame, legal: DataFrame) -> DataFrame:
    """Steps of a history (entity, seq, status) that are not among the ``legal`` ones (before, status), a table of few rows."""
    before = F.lag("status").over(Window.partitionBy("entity").orderBy("seq"))
    steps = history.withColumn("before", before).where("before IS NOT NULL")
    return steps.join(legal, ["before", "status"], "left_anti").select("entity", "seq", "before", "status")


def heads(revisions: DataFrame) -> DataFrame:
    """(tree_id, revision_id): the latest revision of each tree."""
    return revisions.groupBy("tree_id").agg(F.max_by("revision_id", F.struct("created", "revision_id")).alias("revision_id"))


def revision_chain(revisions: DataFrame, start: DataFrame) -> DataFrame:
    """(tree_id, revision_id, step) from each head back over its parents to the first, by doubling.

    Table k holds, for every revision that has so many ancestors, the one 2^k steps back, and is joined
    with itself to the next; a chain of n steps takes log2(n) written tables. A head's length is read off
    the tables from the longest steps down, and each of its steps follows the tables of the step's
    binary digits, in one job. A head whose parents run into a cycle is walked step by step, and a
    revision that is its own ancestor is not followed again.
    """
    spark, root = revisions.sparkSession, f"{shared_dir(revisions.sparkSession)}/jumps-{uuid.uuid4().hex}"
    jump, jumps, most = revisions.where("parent_id IS NOT NULL").select(F.col("revision_id").alias("at"), F.col("parent_id").alias("up")).distinct(), [], None
    while True:
        seen = Observation()
        path = f"{root}/{len(jumps)}"
        jump.observe(seen, F.count("*").alias("n")).write.parquet(path)
        jump, left = spark.read.schema(jump.schema).parquet(path), seen.get["n"]
        most = left if most is None else most
        if not left or 1 << len(jumps) > most:
            break  # what is left runs into a cycle, as no chain is longer than the number of parents
        jumps.append(jump)
        jump = jump.alias("a").join(jump.alias("b"), F.col("a.up") == F.col("b.at")).select("a.at", "b.up")
    heads = start.select("tree_id", "revision_id")
    cyclic = None
    if left:
        cyclic = heads.join(jump.select(F.col("at").alias("revision_id")), "revision_id", "left_semi")
        heads = heads.join(jump.select(F.col("at").alias("revision_id")), "revision_id", "left_anti")

    def follow(rows: DataFrame, k: int, wanted: Column) -> DataFrame:
        step = jumps[k].select(F.col("at").alias("__at"), F.col("up").alias("__up"))
        met = rows.join(step, wanted & (rows["now"] == step["__at"]), "left")
        return met.withColumn("went", F.when(F.col("__up").isNotNull(), 1 << k).otherwise(0)).withColumn("now", F.coalesce("__up", "now")).drop("__at", "__up")

    far = heads.select("tree_id", "revision_id", F.col("revision_id").alias("now"), F.lit(0).alias("length"))
    for k in reversed(range(len(jumps))):
        far = follow(far, k, F.lit(True)).withColumn("length", F.col("length") + F.col("went")).drop("went")
    far.select("tree_id", "revision_id", "length").write.parquet(f"{root}/lengths")
    rows = spark.read.schema(far.select("tree_id", "revision_id", "length").schema).parquet(f"{root}/lengths")
    rows = rows.select("tree_id", F.col("revision_id").alias("now"), F.explode(F.sequence(F.lit(0), F.col("length"))).alias("step"))
    for k in range(len(jumps)):
        rows = follow(rows, k, rows["step"].bitwiseAND(1 << k) != 0).drop("went")
    out = rows.select("tree_id", F.col("now").alias("revision_id"), "step")
    return out if cyclic is None else out.unionByName(_walked_chain(revisions, cyclic))


def _walked_chain(revisions: DataFrame, start: DataFrame) -> DataFrame:
    """The chain one join a step, ending before a revision that was met."""
    first = start.select("tree_id", "revision_id", F.lit(0).alias("step"), F.array("revision_id").alias("met"))
    up = revisions.where("parent_id IS NOT NULL").select(F.col("revision_id").alias("at"), F.col("parent_id").alias("up"))

    def step(level: DataFrame) -> DataFrame:
        older = level.join(up, level["revision_id"] == up["at"]).where(~F.array_contains("met", F.col("up")))
        return older.select("tree_id", F.col("up").alias("revision_id"), (F.col("step") + 1).alias("step"), F.array_append("met", F.col("up")).alias("met"))

    return grow(first, step).drop("met")


def reached(edges: DataFrame, root: DataFrame) -> DataFrame:
    """(node_id): all nodes that can be reached from those of ``root``, each met once whatever leads to it."""
    spark, path = edges.sparkSession, f"{shared_dir(edges.sparkSession)}/reached-{uuid.uuid4().hex}"
    level, k = root.select("node_id").distinct(), 0
    while True:
        seen = Observation()
        level.observe(seen, F.count("*").alias("n")).write.parquet(f"{path}/{k}")
        met = spark.read.schema(root.select("node_id").schema).parquet(*(f"{path}/{i}" for i in range(k + 1)))
        if not seen.get["n"]:
            return met
        last = spark.read.schema(met.schema).parquet(f"{path}/{k}")
        below = last.join(edges, last["node_id"] == edges["parent_id"]).select(F.col("child_id").alias("node_id")).distinct()
        level, k = below.join(met, "node_id", "left_anti"), k + 1


def in_cycles(edges: DataFrame) -> DataFrame:
    """(node_id): nodes on a cycle, or on a way from one cycle to another, left when nodes without an edge in or out are peeled off."""
    spark, path, k, before = edges.sparkSession, f"{shared_dir(edges.sparkSession)}/peeled-{uuid.uuid4().hex}", 0, None
    left = edges.select("parent_id", "child_id").distinct()
    while True:
        seen = Observation()
        left.observe(seen, F.count("*").alias("n")).write.parquet(f"{path}/{k}")
        left, n = spark.read.schema(left.schema).parquet(f"{path}/{k}"), seen.get["n"]
        if not n or n == before:
            return left.select(F.col("parent_id").alias("node_id")).distinct()
        into, out = left.select(F.col("child_id").alias("parent_id")).distinct(), left.select(F.col("parent_id").alias("child_id")).distinct()
        left, before, k = left.join(into, "parent_id", "left_semi").join(out, "child_id", "left_semi").select("parent_id", "child_id"), n, k + 1


def latest(runs: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest row of each key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*map(F.desc, order)))
    return runs.withColumn("k", rank).where("k = 1").drop("k")
