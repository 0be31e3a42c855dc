"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, is_empty
from .adjacency import renumber, restrict


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, component: the smallest node that is reachable when directions are ignored."""
    e = cut(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct())
    while True:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        e = cut(large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        # done when the pairs are stars: each node has one centre, and no centre is a leaf
        leaves = e.groupBy("u").agg(F.count("*").alias("k"))
        if is_empty(leaves.where("k > 1")) and is_empty(e.join(leaves.select(F.col("u").alias("v")), "v", "left_semi")):
            break
    return nodes.select("node_id").join(e.select(F.col("u").alias("node_id"), F.col("v").alias("c")), "node_id", "left").select("node_id", F.coalesce("c", "node_id").alias("component"))


def largest_component(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id of the largest component; among equals the one with the smallest first node."""
    labelled = cut(components(nodes, edges))
    best = labelled.groupBy("component").agg(F.count("*").alias("n")).agg(F.min_by("component", F.struct(-F.col("n"), F.col("component"))).alias("component"))
    return labelled.join(F.broadcast(best), "component", "left_semi").select("node_id")  # one row


def largest_set(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph of the largest component with nodes renumbered in their order."""
    kept = cut(largest_component(nodes, edges))
    n = nodes.join(kept, "node_id", "left_semi")
    new_nodes, new_edges, _ = renumber(n, restrict(edges, kept), ["node_id"])
    return new_nodes, new_edges


def reachable(edges: DataFrame, start: DataFrame, hops: int | None = None) -> DataFrame:
    """node_id, hop: fewest edges from any start node; ``hops`` bounds the search."""
    seen = cut(start.select("node_id", F.lit(0).cast("long").alias("hop")).distinct())
    step = 0
    while hops is None or step < hops:
        new = seen.where(F.col("hop") == step).join(edges.select(F.col("src").alias("node_id"), "dst"), "node_id").select(F.col("dst").alias("node_id")).distinct().join(seen, "node_id", "left_anti").withColumn("hop", F.lit(step + 1).cast("long"))
        new = cut(new)
        if is_empty(new):
            break
        seen = cut(seen.unionByName(new))
        step += 1
    return seen


def hop_bfs(edges: DataFrame, cores: DataFrame, cell: DataFrame | None = None) -> DataFrame:
    """node_id, hop, core: fewest hops from a core and the core that owns the node (the first in the order of cores on a tie).

    cores: node_id, order.  With ``cell`` (node_id, cell) the search stays inside cells.
    """
    e = edges.select("src", "dst")
    if cell is not None:
        c = cell.select("node_id", "cell")
        e = e.join(c.toDF("src", "c1"), "src").join(c.toDF("dst", "c2"), "dst").where("c1 = c2").select("src", "dst")
    e = cut(e.distinct())
    seen = cut(cores.select("node_id", F.lit(0).cast("long").alias("hop"), F.struct("order", "node_id").alias("owner")))
    step = 0
    while True:
        reached = seen.where(F.col("hop") == step).join(e, F.col("node_id") == F.col("src")).groupBy(F.col("dst").alias("n")).agg(F.min("owner").alias("owner"))
        new = cut(reached.withColumnRenamed("n", "node_id").join(seen.select("node_id"), "node_id", "left_anti").select("node_id", F.lit(step + 1).cast("long").alias("hop"), "owner"))
        if is_empty(new):
            break
        seen = cut(seen.unionByName(new))
        step += 1
    return seen.select("node_id", "hop", F.col("owner.node_id").alias("core"))
