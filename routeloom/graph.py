"""The graph as tables.

nodes: node_id, lat, lng, rank, partition, level
edges: edge_id, src, dst, cost array<double>, level (null below the overlay), via struct<first, second> (null for originals)

An uncontracted node has the rank UNRANKED, above every other, since ranks are compared.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNRANKED = (1 << 63) - 1
VIA = "struct<first:long,second:long>"


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    dim: int
    metrics: tuple[str, ...] = ()
    mlp_levels: tuple[int, ...] = field(default=(1,))

    def with_(self, **changes) -> Graph:
        return replace(self, **changes)

    def originals(self) -> DataFrame:
        return self.edges.where(F.col("via").isNull())


def node_table(df: DataFrame) -> DataFrame:
    """Fill in the columns that a bare node table lacks."""
    defaults = {"lat": F.lit(0.0), "lng": F.lit(0.0), "rank": F.lit(UNRANKED), "partition": F.lit(0).cast("long"), "level": F.lit(0)}
    return df.select(F.col("node_id").cast("long").alias("node_id"), *[(F.col(c) if c in df.columns else v).alias(c) for c, v in defaults.items()])


def edge_table(df: DataFrame) -> DataFrame:
    defaults = {"level": F.lit(None).cast("int"), "via": F.lit(None).cast(VIA)}
    return df.select("edge_id", "src", "dst", "cost", *[(F.col(c) if c in df.columns else v).alias(c) for c, v in defaults.items()])


def validate(g: Graph) -> DataFrame:
    """Rows that break a rule: what is wrong and the edge's id.  Empty for a usable graph."""
    wrong = (
        F.when(F.col("cost").isNull() | (F.size("cost") != g.dim), "dimension")
        .when(F.exists("cost", lambda c: c.isNull() | (c < 0)), "negative or missing cost")
        .when(F.col("s.node_id").isNull() | F.col("d.node_id").isNull(), "endpoint")
    )
    ids = g.nodes.select("node_id")
    joined = g.edges.alias("e").join(ids.alias("s"), F.col("e.src") == F.col("s.node_id"), "left").join(ids.alias("d"), F.col("e.dst") == F.col("d.node_id"), "left")
    return joined.select(F.col("e.edge_id").alias("edge_id"), wrong.alias("problem")).where("problem is not null")
