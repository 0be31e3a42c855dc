"""Command line: ``python -m routeloom.cli largest-set|partition|prepare|query|evaluate|graph-info|workload|serve``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import Graph
from .operators import adjacency, components, contraction, evaluation, kernel, partitioners, spatial
from .operators.paths import METHODS, path_nodes, solve
from .service import server
from .session import cut, drop_tables
from .sources import fmi, queries, store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="routeloom")
    commands = p.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *args: tuple) -> None:
        c = commands.add_parser(name, help=text)
        for names, options in args:
            c.add_argument(*names, **options)

    graph, out = (("-f", "--graph"), {"required": True}), (("-o", "--out"), {"required": True})
    command("largest-set", "keep the largest connected set of an FMI file", (("-i", "--input"), {"required": True}), out)
    command(
        "partition", "write an MLP file", graph, out,
        (("-m", "--method"), {"choices": ["kmeans", "gonzalez", "merge"], "required": True}),
        (("-p", "--parts"), {"type": int, "nargs": "+", "help": "cells of each level, top down (merge: largest cell of each level, ascending)", "required": True}),
    )
    command("prepare", "contract an FMI file and write the prepared graph", graph, out, (("-m", "--mlp"), {"help": "MLP file; without it all nodes are one cell"}), (("-p", "--percentage"), {"type": float, "help": "part of the nodes that is contracted, 0 to 1, instead of an MLP file"}))
    command(
        "evaluate", "evaluate a method on an evaluation file", graph, out, (("-e", "--eval"), {"required": True}), (("-q", "--method"), {"choices": METHODS, "default": "prp"}),
        (("-t", "--type"), {"choices": ["time", "count", "check", "export"], "required": True}),
    )
    command("graph-info", "count the edges that each method may use", graph, out)
    command("serve", "answer requests over HTTP", graph, (("-q", "--method"), {"choices": METHODS, "default": "prp"}), (("-p", "--port"), {"type": int, "default": 8080}), (("-d", "--html"), {"help": "folder of files to serve"}))
    command("query", "answer an evaluation file", graph, out, (("-e", "--eval"), {"required": True}), (("-q", "--method"), {"choices": METHODS, "default": "prp"}), (("-c", "--counters"), {"action": "store_true"}))
    command("workload", "write random queries", graph, out, (("-n", "--number"), {"type": int, "default": 10_000}), (("-s", "--seed"), {"type": int, "default": 1}))
    return p


def evaluate(g: Graph, asked: DataFrame, method: str, kind: str, out: str) -> None:
    """time: id, time.  count: id, heap_pops, relaxed_edges.  check: counts of right and wrong answers.  export: the four files of each query's search."""
    if kind == "check":
        queries.write_json(evaluation.check(g, asked, method), out)
    elif kind in ("time", "count"):
        queries.write_json_array(solve(g, asked, method, counters=True).select("id", *(("time",) if kind == "time" else ("heap_pops", "relaxed_edges"))), out)
    else:
        asked = cut(asked)
        steps, paths = cut(kernel.trace(g, asked, method)), cut(solve(g, asked, method))
        lines = cut(queries.path_coordinates(path_nodes(paths, g.edges), g.nodes))
        levels = contraction.node_levels(g)
        for q in asked.select("id", "start_id", "end_id").toLocalIterator():  # files are asked for one query each
            own = steps.where(F.col("id") == q["id"])
            at = lambda kind, own=own: own.where(F.col("kind") == kind).select(F.col("value").alias("node_id")).distinct()
            ends = g.nodes.where(F.col("node_id").isin(q["start_id"], q["end_id"])).withColumn("kind", F.lit(0)).unionByName(g.nodes.join(at("meeting"), "node_id").withColumn("kind", F.lit(1)))
            visited = g.nodes.drop("level").join(at("node"), "node_id").join(levels.withColumnRenamed("level", "kind"), "node_id")
            edges = g.edges.join(own.where("kind = 'edge'").select(F.col("value").alias("edge_id")).distinct(), "edge_id")
            queries.export_query(f"{out}/{q['id']}", ends, visited, lines.where(F.col("id") == q["id"]), edges, g.nodes)


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("routeloom").getOrCreate()
    run(a, spark)


def run(a: argparse.Namespace, spark: SparkSession) -> None:
    if a.command == "largest-set":
        g = fmi.read_fmi(spark, a.input)
        nodes, edges = components.largest_set(g.nodes, g.edges)
        fmi.write_fmi(g.with_(nodes=nodes, edges=edges), a.out)
    elif a.command == "partition":
        g = fmi.read_fmi(spark, a.graph)
        made = partitioners.kmeans(g.nodes, a.parts) if a.method == "kmeans" else getattr(partitioners, a.method)(g.nodes, g.edges, a.parts)
        fmi.write_mlp(*made, a.out)
    elif a.command == "prepare":
        g = fmi.read_fmi(spark, a.graph)
        if a.mlp and a.percentage is not None:
            raise SystemExit("either an MLP file or a percentage")
        g = fmi.with_partitions(g, *(fmi.read_mlp(spark, a.mlp) if a.mlp else (None,)))
        store.write_graph(contraction.contract(g) if a.percentage is None else contraction.contract(g, stop_pairs=None, share=a.percentage), a.out)
    else:
        g = store.read_graph(spark, a.graph)
        if a.command == "serve":
            server(g, a.port, a.method, a.html).serve_forever()
        elif a.command == "graph-info":
            queries.write_json(adjacency.used_edges(g), a.out)
        elif a.command == "evaluate":
            asked = spatial.snap(queries.read_queries(spark, a.eval), g.nodes, spatial.grid_bounds(g.nodes))
            evaluate(g, asked, a.method, a.type, a.out)
        elif a.command == "workload":
            queries.write_json(queries.random_queries(g, a.number, a.seed), a.out)
        else:
            asked = spatial.snap(queries.read_queries(spark, a.eval), g.nodes, spatial.grid_bounds(g.nodes))
            queries.write_json(solve(g, asked, a.method, counters=a.counters), a.out)


if __name__ == "__main__":
    try:
        main()
    finally:
        drop_tables(SparkSession.builder.getOrCreate())
