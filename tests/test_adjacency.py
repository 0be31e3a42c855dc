from bisect import bisect_left

import pytest
from graphs import build, rows, some_edges
from pyspark.sql import functions as F

from routeloom.graph import validate
from routeloom.operators import adjacency as adj


@pytest.mark.parametrize("end, key", [(0, "src"), (1, "dst")])
def test_offsets(spark, end, key):
    e = some_edges(1)
    g = build(spark, e, extra_nodes=range(10))
    ends = sorted(x[end] for x in e)
    assert [r[1] for r in rows(adj.offsets(g.nodes, g.edges, key), "node_id", "offset")] == [bisect_left(ends, v) for v in range(10)]


def test_neighbours(spark):
    e = some_edges(2)
    g = build(spark, e, extra_nodes=range(10))
    targets, sources = sorted({(a, b) for a, b, _ in e}), sorted({(b, a) for a, b, _ in e})
    assert rows(adj.targets(g.edges), "node_id", "neighbour") == targets
    assert rows(adj.sources(g.edges), "node_id", "neighbour") == sources
    assert rows(adj.neighbours(g.edges), "node_id", "neighbour") == sorted({*targets, *sources})
    assert rows(adj.degrees(g.nodes, g.edges), "node_id", "out_degree", "in_degree", "degree") == [(v, o, i, o + i) for v in range(10) for o, i in [(sum(a == v for a, _, _ in e), sum(b == v for _, b, _ in e))]]


def test_renumbered_shortcuts_follow(spark):
    e = spark.createDataFrame([(7, 5, 6, None), (3, 0, 5, None), (9, 0, 6, (3, 7))], "edge_id long, src long, dst long, via struct<first:long,second:long>").withColumn("cost", F.array(F.lit(1.0))).withColumn("level", F.lit(None).cast("int"))
    got = {r["edge_id"]: (r["src"], r["dst"], r["via"] and tuple(r["via"])) for r in adj.renumber_edges(e.select("edge_id", "src", "dst", "cost", "level", "via")).collect()}
    assert got == {0: (0, 5, None), 1: (0, 6, (0, 2)), 2: (5, 6, None)}


def test_dedup_keeps_the_smallest_id(spark):
    g = build(spark, [(0, 1, 1), (0, 1, 1), (0, 1, 2)])
    assert rows(adj.dedup_costs(g.edges), "edge_id") == [(0,), (2,)]


def test_validate(spark):
    g = build(spark, some_edges(3))
    assert validate(g).count() == 0
    bad = g.with_(edges=g.edges.withColumn("cost", F.when(F.col("edge_id") == 3, F.array(F.lit(-1.0))).otherwise(F.col("cost"))), nodes=g.nodes.where("node_id <> 2"))
    assert {r[0] for r in rows(validate(bad), "problem")} == {"negative or missing cost", "endpoint"}
