"""Keep-or-prune decisions on tree nodes and the contraction of pruned trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborfolio.sources.written import grow

MIN_SHARPE_GAIN, MAX_RATIO = 0.03, 1.10


def observations(nodes: DataFrame, measured: DataFrame, protocols: list[str]) -> DataFrame:
    """(node_id, protocol, sharpe_delta, node_ratio, father_ratio, passed) for each node and protocol.

    ``measured`` has protocol, node_id, side ('NODE' or 'FATHER'), sharpe, max_drawdown, volatility.
    A missing side fails; with no volatility the drawdown ratio is infinite.
    """
    wanted = nodes.select("node_id").withColumn("protocol", F.explode(F.array(*map(F.lit, protocols))))
    ratio = F.when(F.col("volatility") > 0, F.abs("max_drawdown") / F.col("volatility")).otherwise(F.lit(float("inf")))

    def side(name: str, prefix: str) -> DataFrame:
        return measured.where(F.col("side") == name).select("protocol", "node_id", F.col("sharpe").alias(f"{prefix}_sharpe"), ratio.alias(f"{prefix}_ratio"))

    joined = wanted.join(side("NODE", "node"), ["protocol", "node_id"], "left").join(side("FATHER", "father"), ["protocol", "node_id"], "left")
    delta = F.col("node_sharpe") - F.col("father_sharpe")
    passed = (delta >= MIN_SHARPE_GAIN) & (F.col("node_ratio") <= F.col("father_ratio") * MAX_RATIO)
    return joined.select("node_id", "protocol", delta.alias("sharpe_delta"), "node_ratio", "father_ratio", F.coalesce(passed, F.lit(False)).alias("passed"))


def decisions(observed: DataFrame) -> DataFrame:
    """(node_id, decision, reason): retained only if every protocol passes."""
    why = F.when(F.col("sharpe_delta").isNull(), F.concat("protocol", F.lit(": missing"))).when(~F.col("passed"), F.concat("protocol", F.lit(": failed")))
    grouped = observed.groupBy("node_id").agg(F.bool_and("passed").alias("ok"), F.concat_ws("; ", F.sort_array(F.collect_list(why))).alias("reason"))
    return grouped.select("node_id", F.when(F.col("ok"), "retain").otherwise("prune").alias("decision"), F.when(F.col("ok"), "passes every protocol").otherwise(F.col("reason")).alias("reason"))


def contraction(tree: DataFrame, decided: DataFrame, key: list[str] | None = None) -> DataFrame:
    """([key..,] node_id, action, new_parent) for each non-root node of ``tree`` ([key..,] node_id, parent_id; the root's parent is null).

    Top down, one join for each level: a pruned node under a kept parent is contracted into it; a
    retained node under one pruned level is lifted to the grandparent; under two pruned levels the
    branch is cut; anything below a cut goes with it; a pruned node under a pruned one is removed.
    With a ``key``, such as the fold, every key has decisions and a tree of its own, and one walk takes them all.
    """
    key = key or []
    kind, no = tree.schema["node_id"].dataType, F.lit(False)
    pruned = F.coalesce(F.col("decision") == "prune", no).alias("pruned")
    marked = tree.join(decided.select(*key, "node_id", "decision"), [*key, "node_id"], "left").select(*key, "node_id", "parent_id", pruned)
    nothing = F.lit(None).cast(kind)
    root = marked.where("parent_id IS NULL").select(*key, "node_id", no.alias("pruned"), no.alias("parent_pruned"), nothing.alias("parent"), no.alias("cut"), F.lit(None).cast("string").alias("action"), nothing.alias("new_parent"))

    def step(level: DataFrame) -> DataFrame:
        above = level.select(*key, F.col("node_id").alias("parent_id"), F.col("pruned").alias("up"), F.col("parent_pruned").alias("up_parent_pruned"), F.col("parent").alias("grandparent"), F.col("cut").alias("up_cut"))
        now = marked.join(above, [*key, "parent_id"])
        two = F.col("up") & F.col("up_parent_pruned")
        action = (
            F.when(F.col("up_cut"), "removed_with_ancestor")
            .when(~F.col("up"), F.when(F.col("pruned"), "contracted").otherwise("kept"))
            .when(two, "removed_with_ancestor")
            .otherwise(F.when(F.col("pruned"), "removed_with_ancestor").otherwise("lifted"))
        )
        now = now.withColumn("action", action)
        lifted = F.col("action") == "lifted"
        new_parent = F.when(lifted, F.col("grandparent")).when(F.col("action") == "kept", F.col("parent_id"))
        # A lifted node's parent is the (kept) grandparent from here on.
        current = F.when(lifted, F.col("grandparent")).otherwise(F.col("parent_id"))
        return now.select(*key, "node_id", "pruned", F.when(lifted, False).otherwise(F.col("up")).alias("parent_pruned"), current.alias("parent"), (F.col("up_cut") | two).alias("cut"), "action", new_parent.alias("new_parent"))

    return grow(root, step).where("action IS NOT NULL").select(*key, "node_id", "action", "new_parent")


def pruned_edges(actions: DataFrame) -> DataFrame:
    """(parent_id, child_id) of the contracted tree."""
    return actions.where("action IN ('kept', 'lifted')").select(F.col("new_parent").alias("parent_id"), F.col("node_id").alias("child_id"))


def contracted_slots(slots: DataFrame, actions: DataFrame, roots: DataFrame, key: list[str] | None = None) -> DataFrame:
    """([key..,] node_id, instrument, child_id, lo, hi): what the nodes of the contracted tree may hold, as the passes take it.

    ``slots`` (node_id, instrument, child_id, lo, hi) is the tree before, ``actions`` what ``contraction`` gave,
    ``roots`` ([key..,] node_id). A contracted child's slot becomes its proxy as an instrument of the
    parent, promoted once; a lifted child's slot moves to its new parent with its bounds; slots of nodes
    that are gone go with them. If a node would hold a name twice, a child's slot stays before an
    instrument of its own, and that before a promoted proxy; of several of a kind that of the first child.
    """
    key = key or []
    alive = actions.where("action IN ('kept', 'lifted')").select(*key, "node_id").unionByName(roots.select(*key, "node_id"))
    columns = ["instrument", "child_id", "lo", "hi"]
    own = slots.where("child_id IS NULL").join(alive, "node_id").select(*key, "node_id", *columns, F.lit("").alias("turn"), F.lit(1).alias("rank"))
    child = slots.where("child_id IS NOT NULL").join(actions.withColumnRenamed("node_id", "child_id"), "child_id")
    stays = child.where("action IN ('kept', 'lifted')").select(*key, F.col("new_parent").alias("node_id"), *columns, F.col("child_id").alias("turn"), F.lit(0).alias("rank"))
    none = F.lit(None).cast(slots.schema["child_id"].dataType).alias("child_id")
    promoted = child.where("action = 'contracted'").select(*key, "node_id", "instrument", none, "lo", "hi", F.col("child_id").alias("turn"), F.lit(2).alias("rank"))
    once = Window.partitionBy(*key, "node_id", "instrument").orderBy("rank", "turn")
    rows = own.unionByName(stays).unionByName(promoted).withColumn("k", F.row_number().over(once))
    return rows.where("k = 1").select(*key, "node_id", *columns)


def summary(decided: DataFrame) -> DataFrame:
    """One row per fold: how many nodes were retained and pruned."""
    return decided.groupBy("fold_id").agg(F.count_if(F.col("decision") == "retain").alias("retained"), F.count_if(F.col("decision") == "prune").alias("pruned"))


def prune_rate(decided: DataFrame) -> DataFrame:
    return decided.groupBy("node_id").agg(F.avg((F.col("decision") == "prune").cast("double")).alias("prune_rate"), F.count("*").alias("folds"))


def global_guard(measured: DataFrame) -> DataFrame:
    """(candidate, accepted) from (candidate, protocol, side 'BASE' or 'CANDIDATE', sharpe, max_drawdown, volatility)."""
    ratio = F.when(F.col("volatility") > 0, F.abs("max_drawdown") / F.col("volatility")).otherwise(F.lit(float("inf")))
    wide = measured.groupBy("candidate", "protocol").agg(
        *(F.max(F.when(F.col("side") == s, v)).alias(f"{s}_{n}") for s in ("BASE", "CANDIDATE") for n, v in (("sharpe", F.col("sharpe")), ("ratio", ratio)))
    )
    ok = (F.col("CANDIDATE_sharpe") >= F.col("BASE_sharpe")) & (F.col("CANDIDATE_ratio") <= F.col("BASE_ratio") * MAX_RATIO)
    return wide.groupBy("candidate").agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("accepted"))


def select_profiles(measured: DataFrame) -> DataFrame:
    """(node_id, signal, profile): the profile of highest Sharpe; none measured counts least, ties go to the first name."""
    order = Window.partitionBy("node_id", "signal").orderBy(F.coalesce("sharpe", F.lit(float("-inf"))).desc(), "profile")
    return measured.withColumn("k", F.row_number().over(order)).where("k = 1").select("node_id", "signal", "profile")
