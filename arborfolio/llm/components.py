"""Connected components by Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace


#: Edges of one node that a task should meet; a node with more is dealt over several.
HUB_EDGES = 1_000_000
BROADCAST_HUBS = 100_000


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component): for every node of ``edges`` (a, b long), the smallest node it can reach.

    Each round points every node at the smallest label among its own, its neighbours' and its
    label's, so paths halve; labels are written to the shared folder between rounds. The edges of a
    node with very many neighbours are dealt over several keys, to each of which its label is sent,
    and the minimum over neighbours is taken before the shuffle.
    """
    space = Workspace(edges.sparkSession, "components")
    both = edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = space.write(both.distinct(), "edges")
    hubs = both.groupBy("b").agg(F.ceil(F.count("*") / HUB_EDGES).cast("int").alias("parts")).where("parts > 1")
    hubs = space.write(hubs, "hubs")
    some = hubs.count()
    if some <= BROADCAST_HUBS:  # rows of 12 bytes
        hubs = F.broadcast(hubs)
    if some:
        turn = F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).cast("int")
        both = space.write(both.join(hubs, "b", "left").select("a", "b", turn.alias("turn")), "dealt")
    labels = space.write(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")), "labels0")
    for k in range(1, rounds + 1):
        sent, on = labels, both["b"] == labels["node"]
        if some:
            turns = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
            sent = labels.join(hubs, labels["node"] == hubs["b"], "left").select("node", "component", turns.alias("turn"))
            on = (both["b"] == sent["node"]) & (both["turn"] == sent["turn"])
        around = both.join(sent, on).groupBy("a").agg(F.min("component").alias("least"))
        hop = labels.select(F.col("node").alias("at"), F.col("component").alias("beyond"))
        near = labels.join(around, labels["node"] == around["a"]).select("node", F.col("component").alias("old"), F.least("component", "least").alias("near"))
        nearer = near.join(hop, near["near"] == hop["at"]).select("node", "old", F.least("near", "beyond").alias("component"))
        written = space.write(nearer, f"labels{k}")
        changed = written.where("old <> component").limit(1).count()
        labels = written.select("node", "component")
        if k > 1:
            space.drop(f"labels{k - 2}")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
