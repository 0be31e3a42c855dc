"""Multi-level partitioners.  Each returns node_id, partition and the branching factors, bottom up."""

from __future__ import annotations

from math import prod

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, is_empty

SEED = 42


def _splitter(split, k: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node_id", ignore_index=True)
        return pd.DataFrame({"node_id": rows["node_id"], "part": rows["cell"] * k + split(rows, k)})

    return run


def _nested(nodes: DataFrame, factors: list[int], split, cells: DataFrame | None = None) -> DataFrame:
    """Split top down: each parent cell is one group of ``split(rows, k) -> node_id, part``."""
    cells = nodes.withColumn("cell", F.lit(0).cast("long")) if cells is None else cells
    for k in factors:
        parts = cells.groupBy("cell").applyInPandas(_splitter(split, k), "node_id long, part long")
        cells = cut(nodes.join(parts.withColumnRenamed("part", "cell"), "node_id"))
    return cells.select("node_id", F.col("cell").alias("partition"))


def _lloyd(rows: pd.DataFrame, k: int) -> np.ndarray:
    x = rows[["lat", "lng"]].to_numpy(float)
    rng = np.random.default_rng(SEED + int(rows["cell"].iloc[0]))
    centre = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    own = np.full(len(x), -1)
    for _ in range(100):
        d = np.stack([((x - c) ** 2).sum(1) for c in centre], axis=1)
        new = d.argmin(1)
        if (new == own).all():
            break
        own = new
        for c in range(len(centre)):
            if (own == c).any():
                centre[c] = x[own == c].mean(0)
    return own


def kmeans(nodes: DataFrame, factors: list[int], group_rows: int = 1_000_000) -> tuple[DataFrame, tuple[int, ...]]:
    """Lloyd on positions.  factors: top down.  The top level runs distributed if it has over ``group_rows`` nodes; a cell below it is one task's work."""
    if nodes.count() <= prod(factors):
        raise ValueError("there are no more nodes than cells")
    n = cut(nodes.select("node_id", "lat", "lng"))
    if n.count() <= group_rows:
        return _nested(n, factors, _lloyd), tuple(factors[::-1])
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    ready = VectorAssembler(inputCols=["lat", "lng"], outputCol="features").transform(n)
    top = KMeans(k=factors[0], seed=SEED).fit(ready).transform(ready).select("node_id", F.col("prediction").cast("long").alias("cell"))
    return _nested(n, factors[1:], _lloyd, cut(n.join(top, "node_id"))), tuple(factors[::-1])


def _farthest_points(k: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(rows["node_id"].tolist())
        near: dict[int, list[int]] = {v: [] for v in ids}
        for v, targets in zip(rows["node_id"], rows["near"]):
            near[v] = sorted(w for w in targets if w in near)
        far = 1 << 60
        distance, owner = dict.fromkeys(ids, far), dict.fromkeys(ids, 0)
        core = ids[-1]
        for c in range(k):
            if c:
                core = max(ids, key=lambda v: (distance[v], v))
                if distance[core] == 0:
                    break
            distance[core], owner[core] = 0, c
            front, hop = [core], 0
            while front:
                hop += 1
                new = []
                for v in front:
                    for w in near[v]:
                        if hop < distance[w]:
                            distance[w], owner[w] = hop, c
                            new.append(w)
                front = new
        return pd.DataFrame({"node_id": ids, "part": [int(rows["cell"].iloc[0]) * k + owner[v] for v in ids]})

    return run


def gonzalez(nodes: DataFrame, edges: DataFrame, factors: list[int]) -> tuple[DataFrame, tuple[int, ...]]:
    """Farthest-point cells by hops inside the parent cell.

    The first core is the cell's node of the largest id; each next core is the node farthest
    from all cores so far (the larger id on a tie); a node belongs to the nearest core, the
    earlier one on a tie.  Nodes that no core reaches inside the cell go to core 0, so every
    node has exactly one cell.
    """
    adjacency = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    cells = cut(nodes.select("node_id", F.lit(0).cast("long").alias("cell")))
    for k in factors:
        own = cells.toDF("dst", "c2")
        inside = adjacency.join(cells.toDF("src", "c1"), "src").join(own, "dst").where("c1 = c2").groupBy("src").agg(F.collect_list("dst").alias("near"))
        grouped = cells.join(inside.withColumnRenamed("src", "node_id"), "node_id", "left").withColumn("near", F.coalesce("near", F.array().cast("array<long>")))
        cells = cut(grouped.groupBy("cell").applyInPandas(_farthest_points(k), "node_id long, part long").withColumnRenamed("part", "cell").select("node_id", "cell"))
    return cells.withColumnRenamed("cell", "partition"), tuple(factors[::-1])


def merge(nodes: DataFrame, edges: DataFrame, sizes: list[int] | None = None, amounts: list[int] | None = None, values: list[float] | None = None) -> tuple[DataFrame, tuple[int, ...]]:
    """Agglomerative cells by rounds in which mutually best neighbours merge.

    The priority of a pair grows with the edges between it and shrinks with its size:
    ``edges * (1 + border(a) + border(b) - border(a and b)) / (size(a) * size(b))``, times a
    hashed factor from 1 to 1.01 that settles ties.  sizes: largest cell of each level,
    ascending; the cells of a level are merged on for the next.  amounts, instead of or beside
    them: number of cells at which each level ends, descending.  A list given as ``values`` gets
    the sum of the priorities of all merges.
    """
    total, stops = 0.0, max(len(sizes or ()), len(amounts or ()))
    at = lambda limits, k: limits[k] if limits and k < len(limits) else None
    pairs = cut(edges.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct())
    cells = cut(nodes.select("node_id", F.col("node_id").alias("cell")))
    snapshots = []
    for level in range(stops):
        size, amount = at(sizes, level), at(amounts, level)
        while True:
            if amount is not None:
                spare = cells.select("cell").distinct().count() - amount
                if spare <= 0:
                    break
            n = cut(cells.groupBy("cell").agg(F.count("*").alias("n")))
            between = pairs.join(cells.toDF("u", "a"), "u").join(cells.toDF("v", "b"), "v").where("a <> b")
            sides = F.explode(F.array(F.struct(F.col("a"), F.col("b"), F.col("u")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("v").alias("u"))))
            directed = cut(between.select(sides.alias("x")).select("x.*"))
            # each cell: its nodes with a foreign neighbour; each ordered pair: the edges, and the nodes on the first side
            cell = directed.groupBy("a").agg(F.countDistinct("u").alias("border")).join(n.toDF("a", "n"), "a")
            sided = directed.groupBy("a", "b").agg(F.countDistinct("u").alias("shared"), F.count("*").alias("conn"))
            one = sided.join(cell, "a").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "conn", "shared", "border", "n")
            both = one.groupBy("lo", "hi").agg(F.first("conn").alias("conn"), F.sum("shared").alias("shared"), F.sum("border").alias("border"), F.sum("n").alias("size"), F.product("n").alias("product"))
            both = both if size is None else both.where(F.col("size") <= size)
            jitter = 1 + F.pmod(F.xxhash64("lo", "hi", F.lit(SEED)), F.lit(1 << 20)) / F.lit(float(1 << 20)) * 0.01
            ranked = cut(both.select("lo", "hi", F.struct((F.col("conn") * (1 + F.col("border") - F.col("shared")) / F.col("product") * jitter).alias("p"), "lo", "hi").alias("key")))
            best = ranked.select(F.explode(F.array("lo", "hi")).alias("cell"), "key").groupBy("cell").agg(F.max("key").alias("key"))
            # a pair merges if it is the best of both its cells
            mutual = best.groupBy("key").agg(F.count("*").alias("k")).where("k = 2").select(F.col("key.lo").alias("into"), F.col("key.hi").alias("cell"), "key.p")
            mutual = cut(mutual if amount is None else mutual.orderBy(F.desc("p"), "into").limit(spare))
            if is_empty(mutual):
                break
            if values is not None:
                total += mutual.agg(F.sum("p")).first()[0]
            mutual = mutual.drop("p")
            cells = cut(cells.join(mutual, "cell", "left").select("node_id", F.coalesce("into", "cell").alias("cell")))
        snapshots.append(cells)
    if values is not None:
        values.append(total)
    # ids: number of the child within its parent, composed from the top
    table = snapshots[0].withColumnRenamed("cell", "c0")
    for k, s in enumerate(snapshots[1:], 1):
        table = table.join(s.withColumnRenamed("cell", f"c{k}"), "node_id")
    top = len(snapshots) - 1
    table = cut(table)
    ids, factors = None, []
    for k in range(top, -1, -1):
        chain = [f"c{j}" for j in range(top, k - 1, -1)]
        own = table.select(*chain).distinct()
        number = own.withColumn("child", F.dense_rank().over(Window.partitionBy(*(chain[:-1] or [F.lit(0)])).orderBy(chain[-1])) - 1)
        factor = number.agg(F.max("child")).first()[0] + 1
        factors.insert(0, factor)
        number = number.withColumn("id", F.col("child").cast("long")) if ids is None else number.join(ids, chain[:-1]).withColumn("id", F.col("parent_id") * factor + F.col("child"))
        ids = cut(number.select(*chain, F.col("id").alias("parent_id")))
    out = table.join(ids, [f"c{j}" for j in range(top, -1, -1)]).select("node_id", F.col("parent_id").alias("partition"))
    return out, tuple(factors)


def partition_sizes(partitions: DataFrame) -> DataFrame:
    """cells, largest and smallest of the cells that hold a node."""
    return partitions.groupBy("partition").agg(F.count("*").alias("n")).agg(F.count("*").alias("cells"), F.max("n").alias("largest"), F.min("n").alias("smallest"))
