"""Graphs derived from the provided tables.

``geo_graph``: vectors as points (first two components) with a height (third), joined to
their four nearest points in both directions; costs are distance, ascent and a constant;
positions run from -50 to 50 degrees.
``part_graph``: parts that follow each other in an order.
``trade_graph``: nations joined by what one sells to the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import Graph, edge_table, node_table
from ..operators.spatial import k_nearest
from ..session import cut, numbered

#: Edges to nearest points, and what a component is scaled by.
NEAREST, SCALE = 4, 10000
CELLS = 8
_kept: dict[tuple[str, str], Graph] = {}


def forget() -> None:
    """Drop the kept graph, so that the next query makes it anew."""
    _kept.clear()


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, y, x, z as whole numbers."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    scaled = lambda i: F.floor((F.col("embedding")[i].cast("double") + 1) * SCALE).cast("long")
    return e.select(F.col("vec_id").alias("node_id"), scaled(0).alias("y"), scaled(1).alias("x"), scaled(2).alias("z"))


def geo_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The geo graph; partition ids of 4 x 4 tiles in 2 x 2 blocks (levels 4, 4).  Kept for the session once made."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _kept:
        return _kept[key]
    p = cut(points(spark, sf_dir))
    near = k_nearest(p, NEAREST)
    pairs = near.select(F.col("f").alias("src"), F.col("t").alias("dst"))
    pairs = pairs.union(pairs.select("dst", "src")).distinct()
    a, b = (p.select(F.col("node_id").alias(n), *[F.col(c).alias(f"{c}{i}") for c in "xyz"]) for i, n in ((1, "src"), (2, "dst")))
    dx, dy = F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2")
    distance = (F.floor(F.sqrt((dx * dx + dy * dy).cast("double"))) + 1).cast("double")
    costs = F.array(distance, F.greatest(F.col("z2") - F.col("z1"), F.lit(0)).cast("double"), F.lit(100.0))
    edges = numbered(pairs.join(a, "src").join(b, "dst").select("src", "dst", costs.alias("cost")), ["src", "dst"], "edge_id")
    tile = lambda c: F.least(F.floor(F.col(c) / (2 * SCALE // 4)), F.lit(3))
    block = F.floor(tile("y") / 2) * 2 + F.floor(tile("x") / 2)
    inner = F.pmod(tile("y"), F.lit(2)) * 2 + F.pmod(tile("x"), F.lit(2))
    nodes = p.select("node_id", (F.col("y") / 200.0 - 50).alias("lat"), (F.col("x") / 200.0 - 50).alias("lng"), (block * 4 + inner).cast("long").alias("partition"))
    g = Graph(cut(node_table(nodes)), cut(edge_table(edges)), 3, ("distance", "ascent", "unit"), (4, 4))
    _kept.clear()
    _kept[key] = g
    return g


def part_graph(spark: SparkSession, sf_dir: str, with_ids: bool = True) -> Graph:
    """Parts by the lines of an order; costs: number of times over, and a constant.  Ties in an order are settled by all columns.

    Numbering the edges takes a sort of them all; what needs no ids leaves it out.
    """
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    steps = li.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst")).where("dst is not null and src <> dst")
    counted = cut(steps.groupBy("src", "dst").agg(F.count("*").alias("n")))
    edges = counted.select("src", "dst", F.array(F.lit(1.0) * F.col("n"), F.lit(1.0)).alias("cost"))
    edges = numbered(edges, ["src", "dst"], "edge_id") if with_ids else edges.withColumn("edge_id", F.lit(None).cast("long"))
    ends = counted.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    return Graph(node_table(ends), edge_table(edges), 2, ("times", "unit"))


def trade_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Nations by sales from suppliers to customers; costs: number of lines and their quantity."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    sold = t("lineitem").select("l_orderkey", "l_suppkey", "l_quantity").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    pairs = sold.groupBy(F.col("s_nationkey").cast("long").alias("src"), F.col("c_nationkey").cast("long").alias("dst")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    edges = numbered(pairs.select("src", "dst", F.array(F.col("n").cast("double"), F.col("q").cast("double")).alias("cost")), ["src", "dst"], "edge_id")
    return Graph(node_table(t("nation").select(F.col("n_nationkey").alias("node_id"))), edge_table(edges), 2, ("lines", "quantity"))
