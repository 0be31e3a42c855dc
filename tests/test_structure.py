import random

import pytest
from graphs import build, distances, grid_graph, rows, some_edges
from pyspark.sql import functions as F

from routeloom.operators import components, contraction, partitioners, spatial
from routeloom.functions import GridBounds, haversine_km
from routeloom.session import cut


def test_node_levels(spark):
    e = [(v, v + 1, 1) for v in range(12)] + [(2, 9, 1)]
    cells = {v: v * 12 // 14 for v in range(14)}
    g = build(spark, e, cells, (2, 3, 2), extra_nodes=range(14))
    want = dict.fromkeys(range(14), 0)
    for a, b, _ in e:
        level = [cells[a] // n == cells[b] // n for n in (1, 2, 6, 12)].index(True)
        want[a], want[b] = max(want[a], level), max(want[b], level)
    assert dict(rows(contraction.node_levels(g), "node_id", "level")) == want and len(set(want.values())) > 2


def test_independent_set(spark):
    e = some_edges(7, nodes=12, count=18)
    g = build(spark, e, extra_nodes=range(12))
    key = {v: (v * 7 % 4, v) for v in range(12)}
    h = spark.createDataFrame([(v, k[0]) for v, k in key.items()], "node_id long, h int")
    near = {v: {b for a, b, _ in e if a == v} | {a for a, b, _ in e if b == v} for v in key}
    assert rows(contraction.independent_set(h, g.edges), "node_id") == [(v,) for v in sorted(key) if all(key[v] < key[u] for u in near[v] - {v})]
    loops = build(spark, [(0, 0, 1), (0, 1, 1)])
    assert rows(contraction.independent_set(loops.nodes.select("node_id", F.lit(1).alias("h")), loops.edges), "node_id") == [(0,)]


def test_lowest_decile(spark):
    h = spark.range(25).select(F.col("id").alias("node_id"), (F.col("id") % 5).alias("h"))
    assert rows(contraction.lowest_decile(h), "node_id") == [(0,), (5,), (10,)]
    assert contraction.lowest_decile(h.limit(7)).count() == 7


def test_components(spark):
    g = build(spark, [(0, 1, 1), (2, 1, 1), (5, 4, 1), (4, 5, 1), (7, 8, 1), (8, 9, 1), (3, 3, 1)], extra_nodes=[6])
    got = dict(rows(components.components(g.nodes, g.edges), "node_id", "component"))
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7, 8: 7, 9: 7}
    assert rows(components.largest_component(g.nodes, g.edges), "node_id") == [(0,), (1,), (2,)]
    n, e = components.largest_set(g.nodes, g.edges)
    assert rows(n, "node_id") == [(0,), (1,), (2,)] and rows(e, "src", "dst") == [(0, 1), (2, 1)]


def test_long_chain_is_one_component(spark):
    g = build(spark, [(i, i + 1, 1) for i in range(60)])
    assert rows(components.components(g.nodes, g.edges).select("component").distinct(), "component") == [(0,)]


def test_hop_bfs(spark):
    e = some_edges(8, nodes=12, count=20)
    g = build(spark, e, extra_nodes=range(12))
    cores = spark.createDataFrame([(4, 0), (1, 1)], "node_id long, order int")
    got = {r["node_id"]: (r["hop"], r["core"]) for r in components.hop_bfs(g.edges, cores).collect()}
    hops = {c: distances([(a, b, [1.0]) for a, b, _ in e], c, [1]) for c in (4, 1)}
    least = {v: min((h[v] for h in hops.values() if v in h), default=None) for v in range(12)}
    assert {v: h for v, (h, _) in got.items()} == {v: h for v, h in least.items() if h is not None}
    assert all(hops[c][v] == h for v, (h, c) in got.items()) and got[4] == (0, 4) and got[1] == (0, 1)


def test_nearest(spark):
    nodes = spark.createDataFrame([(0, 10.0, 10.0), (1, 10.0, 20.0), (2, 20.0, 20.0), (3, 20.0, 10.0)], "node_id long, lat double, lng double")
    points = spark.createDataFrame([(0, 11.0, 11.0), (1, 19.0, 19.5), (2, 50.0, 50.0)], "point_id long, lat double, lng double")
    b = spatial.grid_bounds(nodes)
    assert b == GridBounds(10.0, 20.0, 10.0, 20.0)
    assert rows(spatial.nearest_exact(points, nodes), "point_id", "node_id") == [(0, 0), (1, 2), (2, 2)]
    assert rows(spatial.nearest_ring(points, nodes, b), "point_id", "node_id") == [(0, 0), (1, 2), (2, 2)]


def _plans(monkeypatch):
    """The plans of what is written from now on."""
    seen = []
    monkeypatch.setattr(spatial, "cut", lambda df: (seen.append(df._jdf.queryExecution().toString()), cut(df))[1])
    return seen


@pytest.mark.parametrize("block", [1_000_000, 40])
def test_nearest_exact_compares_no_product(spark, monkeypatch, block):
    r = random.Random(6)
    nodes = [(i, *r.choice([(r.gauss(0, 5), r.gauss(0, 5)), (float(r.randrange(3)), 7.0), (r.uniform(-90, 90), r.uniform(-180, 180))])) for i in range(300)]
    points = [(i, r.uniform(-60, 60), r.uniform(-180, 180)) for i in range(700)] + [(700 + n[0], n[1], n[2]) for n in nodes] + [(1000, None, 3.0)]
    n, p = (spark.createDataFrame(x, f"{c} long, lat double, lng double") for c, x in (("node_id", nodes), ("point_id", points)))
    seen = _plans(monkeypatch)
    found = spatial.nearest_exact(p, n, block)
    seen.append(found._jdf.queryExecution().toString())
    assert not any("NestedLoopJoin" in x or "CartesianProduct" in x for x in seen)
    pairs = p.join(n.select("node_id", F.col("lat").alias("a"), F.col("lng").alias("b"))).withColumn("d", haversine_km(F.col("lat"), F.col("lng"), F.col("a"), F.col("b")))
    want = sorted(tuple(x) for x in pairs.where("d is not null").groupBy("point_id").agg(F.min(F.struct("d", "node_id")).alias("x")).select("point_id", "x.node_id", "x.d").collect())
    assert rows(found, "point_id", "node_id", "distance_km") == [*want, (1000, None, None)]


@pytest.mark.parametrize("block", [1_000_000, 40])
def test_nearest_ring_lists_no_squares(spark, monkeypatch, block):
    r = random.Random(7)
    nodes = [(i, r.gauss(0, 3), r.gauss(0, 3)) for i in range(200)] + [(200, 0.0, 60.0), (201, 40.0, 0.0)]
    points = [(i, r.uniform(-80, 80), r.uniform(-90, 90)) for i in range(600)]
    n, p = (spark.createDataFrame(x, f"{c} long, lat double, lng double") for c, x in (("node_id", nodes), ("point_id", points)))
    b = spatial.grid_bounds(n)
    seen = _plans(monkeypatch)
    found = spatial.nearest_ring(p, n, b, block)
    seen.append(found._jdf.queryExecution().toString())
    assert not any("Generate" in x or "NestedLoopJoin" in x for x in seen)
    i, j = (spatial.grid_index(F.col(c), lo, hi, k) for c, lo, hi, k in (("lat", b.lat_min, b.lat_max, b.lat_cells), ("lng", b.lng_min, b.lng_max, b.lng_cells)))
    pairs = p.withColumns({"pi": i, "pj": j}).join(n.withColumns({"ci": i, "cj": j}).withColumnsRenamed({"lat": "a", "lng": "b"}))
    pairs = pairs.withColumn("ring", F.greatest(F.lit(1), F.abs(F.col("pi") - F.col("ci")), F.abs(F.col("pj") - F.col("cj")))).withColumn("d", haversine_km(F.col("lat"), F.col("lng"), F.col("a"), F.col("b")))
    want = pairs.groupBy("point_id").agg(F.min(F.struct("ring", "d", "node_id")).alias("x"))
    got = rows(found, "point_id", "ring", "node_id", "distance_km")
    assert got == rows(want.select("point_id", "x.ring", "x.node_id", F.col("x.d").alias("distance_km")), "point_id", "ring", "node_id", "distance_km")
    assert max(x[1] for x in got) > 64


def test_k_nearest_is_exact(spark):
    import random

    r = random.Random(2)
    pts = [(i, r.choice([r.randrange(50), r.randrange(3000)]), r.randrange(3000)) for i in range(150)]
    got = rows(spatial.k_nearest(spark.createDataFrame(pts, "node_id long, x long, y long"), 3), "f", "t")
    want = sorted((a[0], b[0]) for a in pts for b in sorted((p for p in pts if p[0] != a[0]), key=lambda p: ((p[1] - a[1]) ** 2 + (p[2] - a[2]) ** 2, p[0]))[:3])
    assert got == want


def test_partitioners(spark):
    g = grid_graph(spark, 6)
    placed = g.nodes.withColumn("lat", F.floor(F.col("node_id") / 6) * 1.0).withColumn("lng", (F.col("node_id") % 6) * 1.0)
    for name, (cells, factors) in {"gonzalez": partitioners.gonzalez(g.nodes, g.edges, [2, 3]), "kmeans": partitioners.kmeans(placed, [2, 3]), "merge": partitioners.merge(g.nodes, g.edges, [4, 12])}.items():
        got = dict(rows(cells, "node_id", "partition"))
        assert sorted(got) == list(range(36)), name
        total = 1
        for f in factors:
            total *= f
        assert max(got.values()) < total, name
    sizes = {}
    for p in got.values():
        sizes[p] = sizes.get(p, 0) + 1
    assert max(sizes.values()) <= 4


def test_gonzalez_starts_at_the_last_node(spark):
    g = build(spark, [(i, i + 1, 1) for i in range(9)])
    cells, factors = partitioners.gonzalez(g.nodes, g.edges, [2])
    assert factors == (2,)
    assert [r[1] for r in rows(cells, "node_id", "partition")] == [1] * 5 + [0] * 5
