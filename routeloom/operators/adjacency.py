"""Neighbourhoods, degrees and closures as joins and unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dominates, vector_add
from ..graph import Graph
from ..session import numbered


def out_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.select(F.col("node_id").alias("src")), "src")


def in_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.select(F.col("node_id").alias("dst")), "dst")


def incident_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node_id, edge_id, outgoing: edges that leave come first."""
    n = nodes.select("node_id")
    out = out_edges(edges, n).select(F.col("src").alias("node_id"), "edge_id", F.lit(True).alias("outgoing"))
    return out.unionByName(in_edges(edges, n).select(F.col("dst").alias("node_id"), "edge_id", F.lit(False).alias("outgoing")))


def targets(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node_id"), F.col("dst").alias("neighbour")).distinct()


def sources(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("node_id"), F.col("src").alias("neighbour")).distinct()


def neighbours(edges: DataFrame) -> DataFrame:
    """Distinct neighbours in either direction."""
    both = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node_id"), F.col("dst").alias("neighbour")), F.struct(F.col("dst").alias("node_id"), F.col("src").alias("neighbour")))).alias("x"))
    return both.select("x.*").distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, out_degree, in_degree, degree in one shuffle: each edge gives a row for either end."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select("x.*")
    all_ = ends.unionByName(nodes.select("node_id", F.lit(0).alias("o"), F.lit(0).alias("i")))
    return all_.groupBy("node_id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree")).withColumn("degree", F.col("out_degree") + F.col("in_degree"))


def offsets(nodes: DataFrame, edges: DataFrame, key: str = "src") -> DataFrame:
    """node_id and the position of its first edge in the table sorted by ``key``: the running sum of counts before it."""
    n = edges.groupBy(F.col(key).alias("node_id")).agg(F.count("*").alias("n"))
    counted = nodes.select("node_id").join(n, "node_id", "left").select("node_id", F.coalesce("n", F.lit(0)).alias("n"))
    # counts of node ranges first, so that the running sum over all nodes is not one task's work
    block = counted.withColumn("block", F.floor(F.col("node_id") / 4096))
    sums = block.groupBy("block").agg(F.sum("n").alias("block_n"))
    before = sums.select("block", F.coalesce(F.sum("block_n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = Window.partitionBy("block").orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    return block.join(before, "block").select("node_id", (F.col("before") + F.coalesce(F.sum("n").over(within), F.lit(0))).cast("long").alias("offset"), F.col("n").cast("long").alias("n"))


def bidirected(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) of the edges and their reversals."""
    return edges.select("src", "dst").union(edges.select("dst", "src")).distinct()


def restrict(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in ``nodes``."""
    n = nodes.select("node_id").distinct()
    return edges.join(n.withColumnRenamed("node_id", "src"), "src", "left_semi").join(n.withColumnRenamed("node_id", "dst"), "dst", "left_semi")


def renumber(nodes: DataFrame, edges: DataFrame, order: list[str | Column]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and edges with dense ids in the given order, and the map (old_id, node_id)."""
    new = numbered(nodes, order, "new_id")
    ids = new.select(F.col("node_id").alias("old_id"), F.col("new_id").alias("node_id"))
    moved = edges.join(ids.toDF("src", "new_src"), "src").join(ids.toDF("dst", "new_dst"), "dst").drop("src", "dst").withColumnsRenamed({"new_src": "src", "new_dst": "dst"})
    return new.drop("node_id").withColumnRenamed("new_id", "node_id"), moved, ids


def renumber_edges(edges: DataFrame) -> DataFrame:
    """Edge ids dense in the order (src, dst, edge_id); ``via`` follows; a ``via`` that names no edge is an error."""
    ids = numbered(edges, ["src", "dst", "edge_id"], "new_id")
    of = ids.select("edge_id", "new_id")
    dangling = F.raise_error(F.lit("a shortcut names an edge that isn't there")).cast("long")
    via = edges.where(F.col("via").isNotNull()).select("edge_id", "via.first", "via.second").join(of.toDF("first", "f"), "first", "left").join(of.toDF("second", "s"), "second", "left").select("edge_id", F.struct(F.coalesce("f", dangling).alias("first"), F.coalesce("s", dangling).alias("second")).alias("new_via"))
    return ids.join(via, "edge_id", "left").drop("edge_id", "via").withColumnsRenamed({"new_id": "edge_id", "new_via": "via"}).select(*edges.columns)


def dedup_costs(edges: DataFrame) -> DataFrame:
    """One edge of each (src, dst, cost): the one of the smallest id."""
    return edges.groupBy("src", "dst", "cost").agg(F.min_by(F.struct("edge_id", "level", "via"), "edge_id").alias("x")).select("x.edge_id", "src", "dst", "cost", "x.level", "x.via")


def shortcut_candidates(edges: DataFrame, contracted: DataFrame) -> DataFrame:
    """via_node, src, dst, cost, first, second for each in-edge and out-edge of the contracted nodes (src and dst differ)."""
    v = contracted.select(F.col("node_id").alias("v"))
    into = edges.join(v, edges["dst"] == v["v"]).select("v", F.col("src"), F.col("cost").alias("c1"), F.col("edge_id").alias("first"))
    out = edges.join(v, edges["src"] == v["v"]).select("v", F.col("dst"), F.col("cost").alias("c2"), F.col("edge_id").alias("second"))
    return into.join(out, "v").where("src <> dst and src <> v and dst <> v").select(F.col("v").alias("via_node"), "src", "dst", vector_add(F.col("c1"), F.col("c2")).alias("cost"), "first", "second")


def skyline(candidates: DataFrame, tie: str) -> DataFrame:
    """Of the candidates (with src, dst, cost) between two nodes those that no other is at most as costly as in every part; of equal ones that of the least ``tie``.

    Sorted by cost, only earlier ones can beat a candidate, so the list of a pair of nodes is gone through once without a join.
    """
    rest = [c for c in candidates.columns if c not in ("src", "dst", "cost")]
    listed = candidates.groupBy("src", "dst").agg(F.array_sort(F.collect_list(F.struct("cost", tie, *[c for c in rest if c != tie]))).alias("s"))
    beats = lambda y, x: dominates(y["cost"], x["cost"]) & ((y["cost"] != x["cost"]) | (y[tie] < x[tie]))
    kept = F.filter("s", lambda x, i: ~F.exists(F.slice(F.col("s"), F.lit(1), i), lambda y: beats(y, x)))
    return listed.select("src", "dst", F.explode(kept).alias("x")).select("src", "dst", "x.cost", *[f"x.{c}" for c in rest])


def least_rank_of_level_one(g: Graph) -> DataFrame:
    """One row: the least rank of a node that a level-1 edge starts from, the greatest number if there is none."""
    starts = g.edges.where("level = 1").select(F.col("src").alias("node_id")).distinct()
    return g.nodes.join(starts, "node_id", "left_semi").agg(F.coalesce(F.min("rank"), F.lit((1 << 63) - 1)).alias("least"))


def used_edges(g: Graph) -> DataFrame:
    """nodes, edges and the edges each method may use.

    prp: the edges of a list up to the last one with a level.  Lists run by falling level, edges
    without one last; of nodes ranked up to the least start of a level-1 edge they run by the
    falling rank of the end, so that edges without a level stand between the others.
    """
    rank = g.nodes.select("node_id", "rank")
    e = g.edges.select("edge_id", "src", "dst", "level", "via").join(rank.toDF("src", "from_rank"), "src").join(rank.toDF("dst", "to_rank"), "dst")
    least = least_rank_of_level_one(g)
    mixed = F.col("from_rank") <= F.col("least")
    # the last edge with a level is the one of the least end; of equal ends those with a level come first
    last = F.min(F.when(F.col("level").isNotNull(), F.col("to_rank"))).over(Window.partitionBy("src"))
    before = mixed & (F.col("to_rank") > F.col("last")) & F.col("level").isNull()
    counts = e.join(F.broadcast(least)).withColumn("last", last).agg(  # one row
        F.count("*").alias("edges"),
        F.sum(F.col("via").isNull().cast("long")).alias("normal_edges"),
        F.count("*").alias("pch_edges"),
        F.count("level").alias("pcrp_edges"),
        F.coalesce(F.sum((F.col("level").isNotNull() | F.coalesce(before, F.lit(False))).cast("long")), F.lit(0)).alias("prp_edges"),
    )
    return g.nodes.agg(F.count("*").alias("nodes")).join(counts)  # one row each
