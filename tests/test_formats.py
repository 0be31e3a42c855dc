import json

from graphs import FORK, build, grid_graph, queries, rows
from pyspark.sql import functions as F

from routeloom.operators import evaluation, spatial
from routeloom.operators.paths import path_nodes, solve
from routeloom.sources import fmi, queries as io, store
from routeloom.streaming.requests import answer


def placed(g):
    return g.with_(nodes=g.nodes.withColumn("lat", F.col("node_id") / 7 + 10.0).withColumn("lng", F.col("node_id") * 0.5 + 1.0))


def test_fmi_and_mlp_round_trip(spark, tmp_path):
    g = placed(build(spark, FORK)).with_(metrics=("time", "gain"))
    fmi.write_fmi(g, str(tmp_path / "g"))
    back = fmi.read_fmi(spark, str(tmp_path / "g"))
    assert back.dim == 2 and back.metrics == ("time", "gain")
    assert rows(back.edges, "edge_id", "src", "dst", "cost") == rows(g.edges, "edge_id", "src", "dst", "cost")
    assert rows(back.nodes, "node_id", "lat", "lng") == rows(g.nodes, "node_id", "lat", "lng")
    parts = g.nodes.select("node_id", (F.col("node_id") % 6).alias("partition"))
    fmi.write_mlp(parts, (3, 2), str(tmp_path / "m"))
    again, factors = fmi.read_mlp(spark, str(tmp_path / "m"))
    assert factors == (3, 2) and rows(again, "node_id", "partition") == rows(parts, "node_id", "partition")
    assert rows(fmi.with_partitions(back, again, factors).nodes, "node_id", "partition") == rows(parts, "node_id", "partition")


def test_fmi_drops_the_separator_and_rejects_a_tail(spark, tmp_path):
    text = "# a comment\n# metrics: x ,, y\n\n1\n2\n1\n0 17 1.50 2.5 9 0\n1 18 3.0 4.0 8 0\n0 1 2.5 -1 -1\n"
    (tmp_path / "a.fmi").write_text(text)
    g = fmi.read_fmi(spark, str(tmp_path / "a.fmi"))
    assert g.metrics == ("x", "y") and rows(g.edges, "src", "dst", "cost") == [(0, 1, [2.5])]
    assert rows(g.nodes, "osm_id", "lat_raw", "height_raw") == [(17, "1.50", "9"), (18, "3.0", "8")]
    (tmp_path / "b.fmi").write_text(text + "7 7 7\n")
    try:
        fmi.read_fmi(spark, str(tmp_path / "b.fmi"))
    except ValueError:
        return
    raise AssertionError("a tail was accepted")


def test_store(spark, tmp_path):
    g = placed(build(spark, FORK)).with_(metrics=("a", "b"))
    store.write_graph(g, str(tmp_path / "s"), 2)
    back = store.read_graph(spark, str(tmp_path / "s"))
    assert rows(back.edges, "edge_id", "cost") == rows(g.edges, "edge_id", "cost")
    assert json.loads(store.metrics(back).first()[0]) == ["a", "b"]


def test_workloads(spark):
    g = placed(build(spark, FORK))
    q = io.random_queries(g, 50, seed=3)
    got = q.collect()
    assert len(got) == 50 and all(abs(sum(r["alpha"]) - 1) < 1e-9 and min(r["alpha"]) > 0 for r in got)
    assert rows(q, "id", "orig_start_id") == rows(io.random_queries(g, 50, seed=3), "id", "orig_start_id")
    assert io.alpha_sweep(spark, 3, 4).count() == 15
    snapped = spatial.snap(q, g.nodes, spatial.grid_bounds(g.nodes)).collect()
    assert all(r["start_id"] == r["orig_start_id"] and r["end_id"] == r["orig_end_id"] for r in snapped)


def test_geojson_and_text(spark):
    g = placed(build(spark, FORK))
    p = solve(g, queries(spark, [(0, 5, [1, 0]), (5, 0, [1, 0])]))
    lines = io.path_coordinates(path_nodes(p, g.edges), g.nodes)
    out = {r["id"]: json.loads(r["feature"]) for r in io.geojson_feature(p, lines).collect()}
    assert out[0]["properties"]["cost"] == "3.00" and len(out[0]["geometry"]["coordinates"]) == 4
    assert out[0]["geometry"]["coordinates"][0] == [1.0, 10.0]
    assert out[1] == {"type": "Feature", "geometry": {"type": "LineString", "coordinates": []}, "properties": {"cost": "no path found"}}
    assert io.wkt_points(g.nodes.where("node_id = 0").withColumn("kind", F.lit(1))).first()[0] == "0;1;POINT(1.0 10.0)"


def test_requests(spark):
    g = placed(build(spark, FORK))
    n = {r["node_id"]: (r["lng"], r["lat"]) for r in g.nodes.collect()}

    def body(a, b, alpha, first=True):
        f = lambda v, p: {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [n[v], n[v]]}} | p
        props = {"properties": {"alpha": alpha}}
        return json.dumps({"type": "FeatureCollection", "features": [f(a, props if first else {}), f(b, {} if first else props)]})

    reqs = [(0, body(0, 5, [1, 0])), (1, body(0, 5, [0, 1], first=False)), (2, body(5, 0, [1, 0])), (3, body(0, 5, None)), (4, body(0, 5, [1])), (5, "nonsense"), (6, None)]
    got = {r["id"]: (r["status"], r["body"]) for r in answer(spark.createDataFrame(reqs, "id long, body string"), g, spatial.grid_bounds(g.nodes)).collect()}
    assert [got[i][0] for i in range(7)] == [200, 200, 200, 400, 400, 400, 400]
    assert '"3.00"' in got[0][1] and '"3.00"' in got[1][1] and "no path found" in got[2][1]


def test_evaluation(spark):
    a = spark.createDataFrame([(1, 1.0), (2, None), (3, 5.0), (4, None), (5, 2.0)], "id long, cost double")
    b = spark.createDataFrame([(1, 1.5), (2, None), (3, None), (4, 7.0), (5, 4.0)], "id long, cost double")
    assert tuple(evaluation.check_buckets(a, b).first()) == (1, 1, 2, 1)
    t = spark.createDataFrame([("normal", "x", 4_000_000), ("prp", "x", 1_000_000), ("prp", "x", 3_000_000)], "method string, setting string, time long")
    assert rows(evaluation.speed_ups(t), "method", "speed_up") == [("normal", 1.0), ("prp", 2.0)]
    s = spark.createDataFrame([("2^10, 4",), ("2^9",), ("2^10",)], "setting string")
    assert [r[0] for r in evaluation.by_summed_setting(s, "setting").select("setting").collect()] == ["2^9", "2^10", "2^10, 4"]
    pre = spark.createDataFrame([("x", 90.0)], "setting string, seconds double")
    con = spark.createDataFrame([("x", 0.75)], "setting string, contracted double")
    r = evaluation.report(t, con, pre, ["normal", "prp"]).first()
    assert (r["prp_speed_up"], r["contracted_percent"], r["minutes"]) == (2.0, 75.0, 1.5)


def test_partition_csv(spark):
    g = placed(grid_graph(spark, 4))
    out = io.partition_csv(g)
    assert out.columns == ["node_id", "lat", "lon", "partition0", "partition1", "highest_diff"] and out.count() == 16
