import json

from graphs import build, rows

from routeloom import cli
from routeloom.sources import fmi, store


def test_from_text_to_answers(spark, tmp_path):
    edges = [(a, b, [float(1 + (a * b) % 5), 1.0]) for i in range(5) for j in range(5) for a in [i * 5 + j] for b in ([a + 1] if j < 4 else []) + ([a + 5] if i < 4 else [])]
    g = build(spark, edges + [(b, a, c) for a, b, c in edges] + [(30, 31, [1.0, 1.0])])
    at = lambda n: str(tmp_path / n)
    fmi.write_fmi(g, at("raw"))
    cli.main(["largest-set", "-i", at("raw"), "-o", at("set")])
    cli.main(["partition", "-f", at("set"), "-m", "gonzalez", "-p", "2", "2", "-o", at("mlp")])
    cli.main(["prepare", "-f", at("set"), "-m", at("mlp"), "-o", at("ready")])
    ready = store.read_graph(spark, at("ready"))
    assert ready.nodes.count() == 25 and ready.mlp_levels == (2, 2)
    asked = [{"id": i, "start_id": i, "end_id": 24 - i, "alpha": [0.5, 0.5]} for i in range(6)]
    (tmp_path / "eval.json").write_text(json.dumps(asked))
    for m in ("normal", "prp"):
        cli.main(["query", "-f", at("ready"), "-e", at("eval.json"), "-q", m, "-o", at(m)])
    a, b = (rows(spark.read.json(at(m)), "id", "cost") for m in ("normal", "prp"))
    assert a == b and len(a) == 6
    cli.main(["workload", "-f", at("ready"), "-n", "7", "-o", at("work")])
    cli.main(["query", "-f", at("ready"), "-e", at("work"), "-o", at("answers"), "-c"])
    assert spark.read.json(at("answers")).where("cost = 0").count() == 7  # all nodes of this graph lie on one point
