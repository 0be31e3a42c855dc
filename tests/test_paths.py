import random

import pytest
from graphs import FORK, build, distances, grid_graph, queries, rows, some_edges

from routeloom.operators import contraction, evaluation
from routeloom.operators.paths import METHODS, path_costs, path_nodes, path_vectors, relax, solve, sssp, unpack


@pytest.mark.parametrize("strategy", ["kernel", "relational"])
def test_costs_and_paths(spark, strategy):
    e = some_edges(4, dim=2)
    g = build(spark, e, extra_nodes=range(10))
    asked = [(a, b, w) for a in (0, 3, 9) for b in range(10) for w in ([1, 0], [0.25, 0.75])] + [(0, 99, [1, 0])]
    got = {r["id"]: (r["path"], r["cost"]) for r in solve(g, queries(spark, asked), strategy=strategy).collect()}
    by_id = {r["edge_id"]: r for r in g.edges.collect()}
    for i, (a, b, w) in enumerate(asked):
        path, cost = got[i]
        assert cost == distances(e, a, w).get(b), (a, b)
        assert (path is None) == (cost is None)
        if path:
            steps = [by_id[x] for x in path]
            assert steps[0]["src"] == a and steps[-1]["dst"] == b and all(x["dst"] == y["src"] for x, y in zip(steps, steps[1:]))
            assert sum(x * y for s in steps for x, y in zip(s["cost"], w)) == cost
        elif path is not None:
            assert a == b and cost == 0
    assert any(c is None for _, c in got.values()) and any(len(p or ()) > 2 for p, _ in got.values())


@pytest.mark.parametrize("alpha, vector, nodes", [([1, 0], [3.0, 15.0], [0, 1, 3, 5]), ([0, 1], [10.0, 3.0], [0, 2, 4, 5])])
def test_preferences_choose_the_way(spark, alpha, vector, nodes):
    g = build(spark, FORK)
    p = solve(g, queries(spark, [(0, 5, alpha)]))
    assert path_vectors(p, g.edges, 2).first()["cost_vector"] == vector and path_nodes(p, g.edges).first()["nodes"] == nodes


def test_parallel_edges_loops_and_ties(spark):
    g = build(spark, [(0, 0, 1), (0, 1, 5), (0, 1, 2), (1, 2, 0), (0, 2, 2)])
    for strategy in ("kernel", "relational"):
        assert solve(g, queries(spark, [(0, 2, [1])]), strategy=strategy).first()["cost"] == 2.0
    assert rows(sssp(g, 0, [1.0]), "node_id", "cost") == [(0, 0.0), (1, 2.0), (2, 2.0)]


def test_empty(spark):
    g = build(spark, some_edges(4))
    assert solve(g, queries(spark, [(0, 4, [1])]).where("id < 0"), strategy="relational").count() == 0
    assert solve(g, queries(spark, [(0, 4, [1])]).where("id < 0")).count() == 0


def test_max_rounds(spark):
    e = some_edges(5)
    g = build(spark, e)
    seed = queries(spark, [(0, 4, [1])]).selectExpr("id query_id", "start_id node_id", "0D cost", "alpha")
    assert rows(relax(g.edges, seed, max_rounds=1), "node_id") == sorted({(0,)} | {(b,) for a, b, _ in e if a == 0})


@pytest.fixture(scope="module")
def overlay(spark):
    return contraction.contract(grid_graph(spark, 8))


def test_methods_agree(spark, overlay):
    r = random.Random(5)
    q = queries(spark, [(r.randrange(64), r.randrange(64), a) for a in ([1, 0], [0, 1], [0.5, 0.5], [0.25, 0.75]) for _ in range(30)])
    expected = solve(overlay, q).cache()
    for method in METHODS[1:]:
        found = solve(overlay, q, method).cache()
        b = evaluation.check_buckets(found, expected, 1e-9).first()
        assert (b["correct_with_path"], b["incorrect_with_path"], b["incorrect_no_path"]) == (120, 0, 0), method
        originals = {x[0] for x in overlay.originals().select("edge_id").collect()}
        assert all(e in originals for p in found.collect() for e in p["path"])
        recomputed = {x["id"]: x["path_cost"] for x in path_costs(found, overlay.edges, q).collect()}
        assert all(abs(recomputed[x["id"]] - x["cost"]) < 1e-9 for x in found.collect())


def test_overlay_rules(spark, overlay):
    top = len(overlay.mlp_levels)
    e = {r["edge_id"]: r for r in overlay.edges.collect()}
    n = {r["node_id"]: r for r in overlay.nodes.collect()}
    assert sorted(e) == list(range(len(e)))
    for x in e.values():
        if x["via"]:
            a, b = e[x["via"]["first"]], e[x["via"]["second"]]
            assert (a["src"], a["dst"], b["dst"]) == (x["src"], b["src"], x["dst"])
            assert x["cost"] == [p + q for p, q in zip(a["cost"], b["cost"])]
        if x["level"] == top:
            assert n[x["src"]]["level"] == n[x["dst"]]["level"] == top
    assert all((v["rank"] == (1 << 63) - 1) == (v["level"] == top) for v in n.values())


def test_relational_unpack(spark, overlay):
    short = [r for r in overlay.edges.where("via is not null").orderBy("edge_id").collect()][-5:]
    p = spark.createDataFrame([(i, [r["edge_id"]]) for i, r in enumerate(short)], "id long, path array<long>")
    whole = {r["id"]: r["path"] for r in unpack(overlay.edges, p).collect()}
    e = {r["edge_id"]: r for r in overlay.edges.collect()}
    for i, r in enumerate(short):
        steps = [e[x] for x in whole[i]]
        assert all(s["via"] is None for s in steps)
        assert steps[0]["src"] == r["src"] and steps[-1]["dst"] == r["dst"]
        assert all(a["dst"] == b["src"] for a, b in zip(steps, steps[1:]))


def test_counters(spark, overlay):
    q = queries(spark, [(0, 63, [0.5, 0.5])])
    c = {m: tuple(solve(overlay, q, m, counters=True).select("heap_pops", "relaxed_edges").first()) for m in METHODS}
    assert all(p > 0 and r > 0 for p, r in c.values())
    assert c["normal"] == tuple(solve(overlay, q, "normal", counters=True).select("heap_pops", "relaxed_edges").first())


def test_trace_and_its_files(spark, overlay, tmp_path):
    from pyspark.sql import functions as F

    from routeloom.operators.kernel import trace
    from routeloom.sources import queries as io

    q = queries(spark, [(0, 63, [0.5, 0.5])])
    for m in METHODS:
        steps = trace(overlay, q, m).collect()
        pops, relaxed = solve(overlay, q, m, counters=True).select("heap_pops", "relaxed_edges").first()
        assert (sum(s["kind"] == "node" for s in steps), sum(s["kind"] == "edge" for s in steps)) == (pops, relaxed)
        assert sum(s["kind"] == "meeting" for s in steps) == (m != "normal")
    p = solve(overlay, q)
    visited = spark.createDataFrame([(s["value"],) for s in steps if s["kind"] == "node"], "node_id long").join(overlay.nodes, "node_id").withColumn("kind", F.lit(0))
    ends = overlay.nodes.where("node_id in (0, 63)").withColumn("kind", F.lit(0))
    io.export_query(str(tmp_path / "q"), ends, visited, io.path_coordinates(path_nodes(p, overlay.edges), overlay.nodes), overlay.originals(), overlay.nodes)
    assert [spark.read.text(str(tmp_path / f"q-{n}")).count() > 0 for n in ("query.wkt", "nodes.wkt", "path.csv", "edges.wkt")] == [True] * 4
