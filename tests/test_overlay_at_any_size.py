"""Overlay searches and contraction as joins, against the searches in arrays."""

import random

import pytest
from graphs import build, grid_graph, queries, rows
from pyspark.sql import functions as F

from routeloom.operators import adjacency, contraction, kernel, paths
from routeloom.operators.paths import path_costs, solve, sssp
from routeloom.session import cut


def asked(spark, n, count):
    r = random.Random(3)
    return queries(spark, [(r.randrange(n), r.randrange(n), a) for a in ([1, 0], [0.25, 0.75]) for _ in range(count)] + [(0, n + 7, [1, 0]), (5, 5, [1, 0])])


@pytest.fixture(scope="module")
def overlay(spark):
    return contraction.contract(grid_graph(spark, 6))


@pytest.mark.parametrize("method", ["pch", "pcrp", "prp"])
def test_relational_methods_agree(spark, overlay, method):
    q = asked(spark, 36, 6)
    want = rows(solve(overlay, q), "id", "cost")
    found = solve(overlay, q, method, "relational").cache()
    assert rows(found, "id", "cost") == want
    again = {r["id"]: r["path_cost"] for r in path_costs(found, overlay.originals(), q).collect()}
    assert all(again[i] == c for i, c in want)


@pytest.mark.parametrize("method", ["normal", "pch", "pcrp", "prp"])
def test_rounds_are_as_many_as_the_blocks_passed(spark, monkeypatch, overlay, method):
    q, writes = asked(spark, 36, 6), []
    want = rows(solve(overlay, q), "id", "cost")
    long = build(spark, [(i, i + 1, [1, 2]) for i in range(150)])
    far = queries(spark, [(0, 150, [1, 0]), (3, 149, [0, 1]), (150, 0, [1, 0])])
    monkeypatch.setattr(paths, "cut", lambda df: (writes.append(1), cut(df))[1])
    chain = {r["id"]: (r["path"], r["cost"]) for r in solve(long, far, method, "relational").collect()} if method == "normal" else {}
    assert len(writes) < 30 and chain in ({}, {0: (list(range(150)), 150.0), 1: (list(range(3, 149)), 292.0), 2: (None, None)})
    for name, value in (("BLOCK_NODES", 5), ("TOGETHER", 3), ("WALK_NODES", 10), ("MERGE_ROUNDS", 2), ("UNPACK_STEPS", 1)):
        monkeypatch.setattr(paths, name, value)
    writes.clear()
    found = solve(overlay, q, method, "relational").cache()
    assert rows(found, "id", "cost") == want and len(writes) > 8
    again = {r["id"]: r["path_cost"] for r in path_costs(found, overlay.originals(), q).collect()}
    assert all(again[i] == c for i, c in want)


@pytest.mark.parametrize("options", [{"cell_edges": 0}, {"cell_edges": 0, "share": 0.5, "decile": True}, {"share": 0.6, "stop_pairs": None}, {"stop_pairs": 6}])
def test_contraction_in_rounds_and_in_part(spark, options):
    g = contraction.contract(grid_graph(spark, 5, seed=2), **options)
    q = asked(spark, 25, 8)
    want = rows(solve(g, q), "id", "cost")
    for method in ("pch", "pcrp", "prp"):
        assert rows(solve(g, q, method), "id", "cost") == want, method
    contracted = g.nodes.where(f"rank < {(1 << 63) - 1}").count()
    assert 0 < contracted < 25
    e = {r["edge_id"]: r for r in g.edges.collect()}
    for x in e.values():
        if x["via"]:
            a, b = e[x["via"]["first"]], e[x["via"]["second"]]
            assert (a["src"], a["dst"], b["dst"]) == (x["src"], b["src"], x["dst"]) and x["cost"] == [p + t for p, t in zip(a["cost"], b["cost"])]


def test_used_edges_equal_the_lists(spark, overlay):
    rank = {r["node_id"]: r["rank"] for r in overlay.nodes.collect()}
    edges = overlay.edges.collect()
    least = min((rank[e["src"]] for e in edges if e["level"] == 1), default=(1 << 63) - 1)
    used = 0
    for v in rank:
        own = [e for e in edges if e["src"] == v]
        own.sort(key=lambda e: (-rank[e["dst"]], e["level"] is None) if rank[v] <= least else (e["level"] is None,))
        used += max((k + 1 for k, e in enumerate(own) if e["level"] is not None), default=0)
    got = adjacency.used_edges(overlay).first()
    assert (got["nodes"], got["edges"], got["normal_edges"], got["prp_edges"]) == (36, len(edges), sum(e["via"] is None for e in edges), used)
    assert got["pcrp_edges"] == sum(e["level"] is not None for e in edges) <= used < len(edges)


def test_arrays_have_a_bound(spark, monkeypatch):
    g = grid_graph(spark, 4)
    q = asked(spark, 16, 3)
    want, tree = rows(solve(g, q, strategy="kernel"), "id", "cost"), rows(sssp(g, 3, [0.5, 0.5], "kernel"), "node_id", "cost")
    monkeypatch.setattr(kernel, "KERNEL_BYTES", 1000)
    assert rows(solve(g, q), "id", "cost") == want and rows(sssp(g, 3, [0.5, 0.5]), "node_id", "cost") == tree
    for refused in (lambda: solve(g, q, counters=True), lambda: kernel.trace(g, q, "normal")):
        with pytest.raises(ValueError):
            refused()


def test_skyline_equals_brute_force(spark):
    r = random.Random(4)
    data = [(r.randrange(2), r.randrange(2), [float(r.randrange(4)), float(r.randrange(4))], i) for i in range(80)]
    got = rows(adjacency.skyline(spark.createDataFrame(data, "src long, dst long, cost array<double>, k long"), "k"), "k")
    beaten = lambda x: any(y[:2] == x[:2] and all(a <= b for a, b in zip(y[2], x[2])) and (y[2] != x[2] or y[3] < x[3]) for y in data)
    assert got == sorted((x[3],) for x in data if not beaten(x))


def test_dangling_shortcuts_are_an_error(spark):
    g = build(spark, [(0, 1, 1), (1, 2, 1)])
    e = g.edges.withColumn("via", F.when(F.col("edge_id") == 1, F.struct(F.lit(0).cast("long").alias("first"), F.lit(77).cast("long").alias("second"))))
    with pytest.raises(Exception, match="names an edge"):
        adjacency.renumber_edges(e).collect()
