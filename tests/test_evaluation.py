"""Evaluation modes, experiment reports, the service, and readers that forgive."""

import json
import threading
import urllib.error
import urllib.request

import pytest
from graphs import FORK, build, grid_graph, queries, rows
from pyspark.sql import functions as F

from routeloom import cli, service
from routeloom.operators import contraction, evaluation, kernel, partitioners, paths
from routeloom.sources import fmi, queries as io, store


def placed(g):
    return g.with_(nodes=g.nodes.withColumn("lat", F.col("node_id") / 7 + 10.0).withColumn("lng", F.col("node_id") * 0.5 + 1.0))


@pytest.fixture(scope="module")
def overlay(spark):
    return placed(contraction.contract(grid_graph(spark, 4))).with_(metrics=("time", "gain"))


def test_experiment(spark, overlay):
    q = queries(spark, [(0, 15, [0.5, 0.5]), (3, 12, [1, 0])])
    times, contracted = evaluation.experiment({"a, 4": overlay, "b, 4": overlay}, q, ["normal", "prp"])
    assert times.count() == 8 and times.where("time <= 0 or heap_pops <= 0").count() == 0
    pre = spark.createDataFrame([("a, 4", 60.0)], "setting string, seconds double")
    got = {r["setting"]: r for r in evaluation.report(times, contracted, pre, ["normal", "prp"]).collect()}
    assert got["a, 4"]["minutes"] == 1.0 and got["b, 4"]["minutes"] is None and got["a, 4"]["prp_speed_up"] > 0
    assert tuple(evaluation.check(overlay, q, "prp").first()) == (2, 0, 0, 0)


def test_names_and_labels(spark):
    d = spark.createDataFrame([("x/south-west-kmeans-4_8.bin",), ("a-merge-2-pch.bin",), ("a.bin",), ("a-kmeans-2.csv",)], "f string")
    got = [r[0] and tuple(r[0]) for r in d.select(evaluation.experiment_name("f", ".bin")).collect()]
    assert got == [("south-west", "kmeans", "4, 8", False), ("a", "merge", "2", True), None, None]
    d = spark.createDataFrame([("kmeans",), ("merge",)], "m string")
    assert [tuple(r) for r in d.select(evaluation.label("m"), evaluation.label("m", upper=True)).collect()] == [("K-means", "KMEANS"), ("Merge", "MERGE")]
    t = spark.createDataFrame([("a", "x", 3_000_000), ("b", "x", 1_000_000), ("a", "y", 1)], "method string, setting string, time long")
    assert rows(evaluation.difference_of_means(t, "a", "b").where("setting = 'x'"), "difference_ms") == [(2.0,)]


def test_resumed_searches(spark):
    g = grid_graph(spark, 5)
    a = kernel.Arrays(*kernel.collect(g))
    one, q = kernel.Resumable(a), [(0, t, [0.5, 0.5]) for t in (24, 3, 24, 11)] + [(7, 2, [0.5, 0.5]), (0, 99, [1, 0])]
    settled = []
    for s, t, alpha in q[:4]:
        one.find(s, t, tuple(alpha))
        settled.append(one.settled)
    assert settled == [settled[0]] * 4 and settled[0] <= 25
    found = {r["id"]: r for r in kernel.vector_paths(g, queries(spark, q)).collect()}
    for r in paths.solve(g, queries(spark, q)).collect():
        f = found[r["id"]]
        assert (f["path"] is None) == (r["cost"] is None) and (r["cost"] is None or sum(0.5 * c for c in f["cost_vector"]) == r["cost"])


def test_own_methods(spark, monkeypatch):
    monkeypatch.setitem(paths.OWN, "nothing", lambda g, q: q.select("id", F.lit(None).cast("array<long>").alias("path"), F.lit(None).cast("double").alias("cost")))
    g = build(spark, FORK)
    assert paths.solve(g, queries(spark, [(0, 5, [1, 0])]), "nothing").first()["cost"] is None


def test_merge_by_number_of_cells(spark):
    g, values = grid_graph(spark, 6), []
    cells, factors = partitioners.merge(g.nodes, g.edges, amounts=[9, 3], values=values)
    assert cells.count() == 36 and cells.select("partition").distinct().count() == 9 and values[0] > 0
    by_parent = cells.select((F.col("partition") / factors[0]).cast("long")).distinct().count()
    assert by_parent == 3


def test_forgiving_reader_and_contraction_ids(spark, tmp_path):
    (tmp_path / "a.fmi").write_text("# by hand\n# metrics: x, y\n\n2\n# three\n3\n\n3\n0 0 1.0 2.0 0 0\n\n1 0 1.5 2.5 0 0\n2 0 2.0 2.0 0 0\n# edges\n0 1 1.0 2.0 -1 -1\n1 2 3.0 4.0 -1 -1\n0 2 4.0 6.0 0 1\n")
    g = fmi.read_fmi(spark, str(tmp_path / "a.fmi"), tolerant=True)
    assert g.metrics == ("x", "y") and g.dim == 2 and g.nodes.count() == 3
    assert [(r["src"], r["dst"], r["cost"], r["via"] and tuple(r["via"])) for r in g.edges.orderBy("edge_id").collect()] == [(0, 1, [1.0, 2.0], None), (1, 2, [3.0, 4.0], None), (0, 2, [4.0, 6.0], (0, 1))]


def test_sweep_pairs_and_result_files(spark, tmp_path, overlay):
    q = io.sweep_between(overlay, (10.0, 1.0), (12.2, 8.4), 4)
    assert q.count() == 5 and rows(q, "orig_start_id", "orig_end_id")[0] == (0, 15)
    n = spark.createDataFrame([(1, [4, 5, 9]), (2, [])], "id long, nodes array<long>")
    assert rows(io.path_pairs(n), "id", "src", "dst") == [(1, 4, 5), (1, 5, 9)]
    d = spark.createDataFrame([(1, 5), (2, 7)], "id long, time long")
    io.write_json_array(d, str(tmp_path / "r.json"))
    assert len(json.loads("".join(r[0] for r in spark.read.text(str(tmp_path / "r.json"), wholetext=True).where("value <> ''").collect()))) == 2
    assert rows(io.read_results(spark, str(tmp_path / "r.json"), "id long, time long"), "id", "time") == [(1, 5), (2, 7)]
    io.write_partition_csv(overlay, str(tmp_path / "p"))
    assert spark.read.csv(str(tmp_path / "p"), header=True).columns == ["lat", "lon", "partition0", "partition1", "highest_diff"]


def test_command_line_modes(spark, tmp_path, overlay):
    at = lambda n: str(tmp_path / n)
    store.write_graph(overlay, at("g"))
    n = {r["node_id"]: {"latitude": r["lat"], "longitude": r["lng"]} for r in overlay.nodes.collect()}
    (tmp_path / "e.json").write_text(json.dumps([{"id": 0, "start_pos": n[0], "end_pos": n[15], "alpha": [0.5, 0.5]}]))
    for kind in ("time", "count", "check", "export"):
        cli.main(["evaluate", "-f", at("g"), "-e", at("e.json"), "-q", "prp", "-t", kind, "-o", at(kind)])
    assert io.read_results(spark, at("time"), "id long, time long").first()["time"] > 0
    assert io.read_results(spark, at("count"), "id long, heap_pops long").first()["heap_pops"] > 0
    assert spark.read.json(at("check")).first()["correct_with_path"] == 1
    assert spark.read.text(at("export/0-nodes.wkt")).count() > 0
    cli.main(["graph-info", "-f", at("g"), "-o", at("info")])
    assert spark.read.json(at("info")).first()["nodes"] == 16


def test_service(overlay, tmp_path):
    (tmp_path / "index.html").write_text("hello")
    s = service.server(overlay, 0, "prp", str(tmp_path))
    threading.Thread(target=s.serve_forever, daemon=True).start()
    url = f"http://localhost:{s.server_address[1]}"
    get = lambda path, body=None: urllib.request.urlopen(urllib.request.Request(url + path, body), timeout=120).read().decode()
    try:
        assert json.loads(get("/metrics")) == ["time", "gain"] and get("/index.html") == "hello"
        n = {r["node_id"]: [r["lng"], r["lat"]] for r in overlay.nodes.collect()}
        f = lambda v, p: {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [n[v], n[v]]}} | p
        body = json.dumps({"type": "FeatureCollection", "features": [f(0, {"properties": {"alpha": [0.5, 0.5]}}), f(15, {})]}).encode()
        assert json.loads(get("/dijkstra", body))["geometry"]["coordinates"][0] == n[0]
        for bad, status in ((b"{}", 400), (b"x" * 2000, 413)):
            with pytest.raises(urllib.error.HTTPError) as e:
                get("/dijkstra", bad)
            assert e.value.code == status
    finally:
        s.shutdown()
