"""Shortest paths for batches of queries, each with its own preference.

Two ways answer the same questions:

* relational: label correction as DataFrame rounds (``settle``).  All queries share the rounds.  The
  nodes lie in blocks of bounded size; in a round each block that labels were sent to goes on from them to
  the end, and sends labels to the blocks that its edges lead to.  So the rounds are as
  many as the blocks that a best path passes, and nothing depends on the graph fitting
  anywhere.  ``pch``, ``pcrp`` and ``prp`` run it from both ends over the overlay edges that
  their rules allow, meet at the cheapest node, and unpack the shortcuts.
* the search kernel (``kernel.py``): graphs whose arrays take up to ``kernel.KERNEL_BYTES`` go to
  the executors, and each batch of queries is searched there with a heap.

``solve`` picks by that size.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from math import inf, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dot
from ..graph import Graph
from ..session import cut, is_empty, numbered
from . import kernel

METHODS = ("normal", "bi", "pch", "pcrp", "prp")
#: Methods of a user's own: name -> (graph, queries) -> id, path, cost.
OWN: dict[str, Callable[[Graph, DataFrame], DataFrame]] = {}
#: Nodes of a block, edges of one as the graph has them on average, of some 150 bytes in a Python task, and, about,
#: queries that search it together, 25 bytes for each node.
BLOCK_NODES, BLOCK_EDGES, TOGETHER = 131_072, 1_600_000, 4
#: Nodes of a region, whose labels of one query, of 40 bytes, are a task's when paths are walked back.
WALK_NODES = 2_000_000
#: Rounds of labels that are merged at a time, and levels of shortcuts that are replaced between two writes.
MERGE_ROUNDS, UNPACK_STEPS = 8, 4
#: The last edge of a label that no edge leads to.
NO_EDGE = -(1 << 63)
LABEL = "side int, bucket long, block long, query_id long, node_id long, cost double, edge_id long, before long, sent boolean"


def relax(edges: DataFrame, seeds: DataFrame, targets: DataFrame | None = None, max_rounds: int | None = None) -> DataFrame:
    """query_id, node_id, cost, edge_id (the last edge of a best path; null at a seed) by rounds of one edge each, max_rounds at most.

    edges: edge_id, src, dst, cost.  seeds: query_id, node_id, cost, alpha, equal within a
    query.  With targets (query_id, target) labels that cannot improve a
    target's cost any more are not followed.  Costs and preferences must not be negative.
    """
    e = cut(edges.select(F.col("edge_id").alias("e"), "src", "dst", F.col("cost").alias("vector")))
    same = [F.any_value("alpha").alias("alpha")]
    labels = cut(seeds.groupBy("query_id", "node_id").agg(F.min("cost").alias("cost"), *same).select("query_id", "node_id", "cost", F.lit(None).cast("long").alias("edge_id"), "alpha", F.lit(True).alias("fresh")))
    rounds = 0
    while max_rounds is None or rounds < max_rounds:
        rounds += 1
        front = labels.where("fresh")
        if targets is not None:
            bound = labels.join(targets.select("query_id", F.col("target").alias("node_id")), ["query_id", "node_id"]).groupBy("query_id").agg(F.min("cost").alias("bound"))
            front = front.join(bound, "query_id", "left").where(F.col("bound").isNull() | (F.col("cost") < F.col("bound"))).drop("bound")
        if is_empty(front):
            break
        step = front.join(e, front["node_id"] == e["src"]).select("query_id", F.col("dst").alias("node_id"), (F.col("cost") + dot("vector", "alpha")).alias("cost"), F.col("e").alias("edge_id"), "alpha", F.lit(True).alias("fresh"))
        # one aggregation merges old and new labels: on equal cost the old one stays, then the smaller edge
        merged = labels.withColumn("fresh", F.lit(False)).unionByName(step).groupBy("query_id", "node_id").agg(F.min(F.struct("cost", "fresh", "edge_id")).alias("x"), *same)
        labels = cut(merged.select("query_id", "node_id", "x.cost", "x.edge_id", "alpha", "x.fresh"))
    return labels.select("query_id", "node_id", "cost", "edge_id")


def block_nodes(g: Graph) -> int:
    """Nodes of a block: fewer where the graph has many edges a node."""
    return max(1, min(BLOCK_NODES, BLOCK_EDGES * g.nodes.count() // max(1, g.edges.count())))


def blocks(nodes: DataFrame, size: int) -> DataFrame:
    """node_id, block: at most ``size`` nodes that lie together, by stripes of the latitude cut along the longitude; without positions by partition and id."""
    n = nodes.count()
    if n <= size:
        return nodes.select("node_id", F.lit(0).cast("long").alias("block"))
    stripe = math.ceil(n / math.ceil(math.sqrt(n / size)))
    striped = numbered(nodes.select("node_id", "lat", "lng", "partition"), ["lat", "partition", "node_id"], "__r").withColumn("__s", F.floor(F.col("__r") / stripe)).drop("__r")
    placed = numbered(striped, ["__s", "lng", "partition", "node_id"], "__k")
    return cut(placed.select("node_id", F.floor(F.col("__k") / size).alias("block")))


def searchable(g: Graph, place: DataFrame, method: str) -> DataFrame:
    """Edges as ``settle`` reads them, by the block of the node that a search leaves: side 0 forward, side 1 (overlay methods) backward.

    Edges that the method never takes from that node are left out; those that aren't ``free`` may
    be taken by queries whose level at the node is at most the edge's; see ``kernel.py``.
    """
    at = g.nodes.join(place, "node_id").select("node_id", "block", "rank", "level", "partition")
    overlay = method in ("pch", "pcrp", "prp")
    edges = (g.edges if overlay else g.originals()).select("edge_id", "src", "dst", "cost", F.coalesce("level", F.lit(-1)).alias("level"))
    up, out = F.col("rank_at") <= F.col("rank_to"), None
    may, free = {"pch": (up, F.lit(True)), "pcrp": (F.col("level") >= 0, F.lit(False)), "prp": (F.when(F.col("level_at") == 0, up).otherwise(F.col("level") >= 1), F.col("level_at") == 0)}.get(method, (F.lit(True), F.lit(True)))
    for side in (0, 1) if overlay else (0,):
        a, b = ("src", "dst") if side == 0 else ("dst", "src")
        e = edges.select("edge_id", F.col(a).alias("src"), F.col(b).alias("dst"), "cost", "level")
        e = e.join(at.toDF("src", "block", "rank_at", "level_at", "part"), "src").join(at.select("node_id", "block", "rank").toDF("dst", "to", "rank_to"), "dst").where(may)
        e = e.select(F.lit(side).alias("side"), "block", "src", "dst", "to", "edge_id", "level", free.alias("free"), "part", *[F.get("cost", F.lit(i)).alias(f"c{i}") for i in range(g.dim)])
        out = e if out is None else out.unionByName(e)
    return cut(out)


def _least(flat: np.ndarray, cost: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Positions of the least (cost, edge) of each value of ``flat``."""
    order = np.lexsort((edge, cost, flat))
    return order[np.flatnonzero(np.r_[True, np.diff(flat[order]) != 0][: len(order)])]


def _search_block(key: tuple, edges: pa.Table, rows: pa.Table, dim: int, levels: tuple[int, ...]) -> pa.Table:
    """Labels of one block that are new, and those sent to other blocks.  rows: its labels, those sent to it, and the queries."""
    side, bucket, block = (k.as_py() for k in key)
    asks = np.asarray(rows["asks"])
    column = lambda c: rows[c].to_numpy()
    order = np.flatnonzero(asks)[np.argsort(column("query_id")[asks])]
    ids, ps, pt, target = (column(c)[order] for c in ("query_id", "ps", "pt", "target"))
    bound = np.nan_to_num(column("cost")[order].astype(float), nan=inf)
    alpha = np.array([a if a is not None and len(a) == dim else [math.nan] * dim for a in rows["alpha"].take(pa.array(order)).to_pylist()], float).reshape(len(ids), dim)
    by = np.lexsort((edges["edge_id"].to_numpy(), edges["src"].to_numpy()))
    src, dst, to, edge = (edges[c].to_numpy()[by] for c in ("src", "dst", "to", "edge_id"))
    level = edges["level"].to_numpy().astype(np.int8)[by]
    free = np.asarray(edges["free"])[by].astype(bool)
    cost_of = [edges[f"c{i}"].to_numpy()[by].astype(float) for i in range(dim)]
    mine = np.flatnonzero(~asks)
    node, value, last_edge, previous, sent = (column(c)[mine] for c in ("node_id", "cost", "edge_id", "before", "sent"))
    inner = to == block
    nodes = np.unique(np.concatenate([np.unique(x.astype(np.int64)) for x in (src, dst[inner], node)]))
    n = len(nodes)
    s, d = (np.searchsorted(nodes, x).astype(np.int32) for x in (src, dst))
    start = np.searchsorted(s, np.arange(n + 1))
    aim = np.where(np.isin(target, nodes), np.searchsorted(nodes, target) + np.arange(len(ids)) * n, -1)
    aimed = np.flatnonzero(aim >= 0)
    if not free.all():
        of = np.zeros(n, np.int64)
        of[s] = edges["part"].to_numpy()[by]
        low = np.full((len(ids), n), len(levels), np.int8)
        for k in range(len(levels) - 1, -1, -1):
            x = prod(levels[:k])
            low[(of // x == (ps // x)[:, None]) | (of // x == (pt // x)[:, None])] = k
        low = low.ravel()
    best, last, before = np.full(len(ids) * n, inf), np.full(len(ids) * n, NO_EDGE), np.zeros(len(ids) * n, np.int64)
    at, new = np.searchsorted(ids, column("query_id")[mine]) * n + np.searchsorted(nodes, node), np.zeros(len(ids) * n, bool)
    for some in (np.flatnonzero(~sent.astype(bool)), np.flatnonzero(sent.astype(bool))):
        some = some[_least(at[some], value[some], last_edge[some])]
        some = some[value[some] < best[at[some]]]
        best[at[some]], last[at[some]], before[at[some]] = value[some], last_edge[some], previous[some]
    front = at[some]
    new[front] = True

    def steps(front: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query, edge and cost of the steps from some labels inside the block or out of it."""
        front = front[best[front] < bound[front // n]]
        v = front % n
        count = start[v + 1] - start[v]
        e = np.repeat(start[v] - np.cumsum(count) + count, count) + np.arange(count.sum())
        label = np.repeat(front, count)
        keep = inner[e] == inside
        if not free.all():
            keep &= free[e] | (level[e] >= low[label])
        e, label = e[keep], label[keep]
        q, w = label // n, 0.0
        for i in range(dim):
            w = w + cost_of[i][e] * alpha[q, i]
        cost = best[label] + w
        keep = cost < bound[q]
        return q[keep], e[keep], cost[keep]

    while len(front):
        bound[aimed] = np.minimum(bound[aimed], best[aim[aimed]])
        # the cheaper half goes first: labels that a cheaper one is about to beat aren't followed
        later = np.zeros(0, np.int64)
        if len(front) > 4 * len(ids):
            half = best[front] <= np.median(best[front])
            front, later = front[half], front[~half]
        q, e, cost = steps(front, True)
        t = q * n + d[e]
        better = cost < best[t]
        t, e, cost = t[better], e[better], cost[better]
        some = _least(t, cost, edge[e])
        t, e = t[some], e[some]
        best[t], last[t], before[t] = cost[some], edge[e], src[e]
        new[t] = True
        front = np.union1d(later, t)
    bound[aimed] = np.minimum(bound[aimed], best[aim[aimed]])
    kept = np.flatnonzero(new & (best <= np.repeat(bound, n)))
    q, e, cost = steps(kept, False)
    away = np.unique(dst[e], return_inverse=True)[1].ravel()
    some = _least(q * (len(edge) + 1) + away, cost, edge[e])
    q, e, cost = q[some], e[some], cost[some]
    same = len(kept) + len(e)
    data = {
        "side": np.full(same, side, np.int32), "bucket": np.full(same, bucket, np.int64), "block": np.r_[np.full(len(kept), block, np.int64), to[e]],
        "query_id": np.r_[ids[kept // n], ids[q]], "node_id": np.r_[nodes[kept % n], dst[e]], "cost": np.r_[best[kept], cost],
        "edge_id": np.r_[last[kept], edge[e]], "before": np.r_[before[kept], src[e]], "sent": np.r_[np.zeros(len(kept), bool), np.ones(len(e), bool)],
    }
    return pa.table(data)


def renamed(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys in front and under other names, since two frames made from one can't be told apart in a cogroup."""
    return df.select(*[F.col(c).alias(f"own_{c}") for c in key], *[c for c in df.columns if c not in key])


def settle(edges: DataFrame, searches: DataFrame, seeds: DataFrame, dim: int, levels: tuple[int, ...] = (1,)) -> DataFrame:
    """Labels (LABEL) of best paths: side, query_id, node_id, cost, edge_id (the last edge; NO_EDGE at a seed), before (the node it comes from).

    edges: as from ``searchable``.  searches: side, bucket, query_id, alpha, ps, pt, target; with a
    target, labels that cannot improve its cost any more are not followed.  seeds: side,
    bucket, block, query_id, node_id.  Costs and preferences must not be negative.
    """
    key = ["side", "bucket", "block"]
    spark = edges.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))  # searches are long for their bytes, by which Spark would put them together
    run = lambda k, e, rows: _search_block(k, e, rows, dim, levels)
    last = cut(seeds.select(*key, "query_id", "node_id", F.lit(0.0).alias("cost"), F.lit(NO_EDGE).alias("edge_id"), F.lit(0).cast("long").alias("before"), F.lit(True).alias("sent")))
    known, rounds = last.where("not sent"), 0
    none = {"alpha": F.lit(None).cast("array<double>"), "ps": F.lit(0).cast("long"), "pt": F.lit(0).cast("long"), "target": F.lit(0).cast("long"), "asks": F.lit(False)}
    merged = lambda: known.groupBy(*key, "query_id", "node_id").agg(F.min(F.struct("cost", "edge_id", "before")).alias("x")).select(*key, "query_id", "node_id", "x.*", F.lit(False).alias("sent"))
    aims = searches.where("target is not null")
    if is_empty(aims):
        aims = aims.limit(0)
    while not is_empty(sent := last.where("sent")):
        active = F.broadcast(sent.select(*key).distinct())  # a row for each block and bucket at most
        reached = known.join(F.broadcast(aims.select("side", "query_id", F.col("target").alias("node_id"))), ["side", "query_id", "node_id"]).groupBy("side", "query_id").agg(F.min("cost").alias("cost"))
        asked = searches.join(reached, ["side", "query_id"], "left").join(active, ["side", "bucket"])
        asked = asked.select(*key, "query_id", F.lit(0).cast("long").alias("node_id"), "cost", F.lit(NO_EDGE).alias("edge_id"), F.lit(0).cast("long").alias("before"), F.lit(False).alias("sent"), "alpha", "ps", "pt", F.coalesce("target", F.lit(NO_EDGE)).alias("target"), F.lit(True).alias("asks"))
        rows = known.join(active, key, "left_semi").unionByName(sent).withColumns(none).unionByName(asked)
        own = renamed(edges.join(active, ["side", "block"]), key)
        last = cut(own.repartition(tasks, *own.columns[:3]).groupBy(*own.columns[:3]).cogroup(rows.repartition(tasks, *key).groupBy(*key)).applyInArrow(run, LABEL))
        known, rounds = known.unionByName(last.where("not sent")), rounds + 1
        if rounds % MERGE_ROUNDS == 0:
            known = cut(merged())
    return cut(merged())


def sssp(g: Graph, source: int, alpha: list[float], strategy: str = "auto") -> DataFrame:
    """node_id and cost from one source over the original edges."""
    if strategy == "kernel" or (strategy == "auto" and kernel.fits(g)):
        return kernel.tree(g, source, alpha)
    place = blocks(g.nodes, block_nodes(g))
    one = place.where(F.col("node_id") == source).select(F.lit(0).alias("side"), F.lit(0).cast("long").alias("bucket"), "block", F.lit(0).cast("long").alias("query_id"), "node_id", F.array(*[F.lit(float(a)) for a in alpha]).alias("alpha"), *[F.lit(0).cast("long").alias(c) for c in ("ps", "pt")], F.lit(None).cast("long").alias("target"))
    return settle(searchable(g, place, "normal"), one.drop("block", "node_id"), one, g.dim).select("node_id", "cost")


def _walk(key: tuple, labels: pa.Table, ends: pa.Table) -> pa.Table:
    """Walks back inside a region; node_id null: arrived."""
    order = np.argsort(labels["node_id"].to_numpy())
    nodes, edge, before = (labels[c].to_numpy()[order] for c in ("node_id", "edge_id", "before"))
    out = []
    for r in ends.to_pylist():
        v, back = r["node_id"], []
        while v is not None:
            at = int(np.searchsorted(nodes, v))
            if at == len(nodes) or nodes[at] != v:
                break
            if edge[at] == NO_EDGE:
                v = None
            else:
                back.append(int(edge[at]))
                v = int(before[at])
        out.append((r["side"], r["query_id"], v, back[::-1] + r["path"]))
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
    return pa.table([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=["side", "query_id", "node_id", "path"])


def walk_paths(labels: DataFrame, place: DataFrame, ends: DataFrame, size: int) -> DataFrame:
    """side, query_id, path (edge ids in order) back from ``ends`` (side, query_id, node_id) along the labels' last edges, a region in each round; size: nodes of a block."""
    region = F.floor(F.col("block") / max(1, WALK_NODES // size)).alias("region")
    labels = labels.select("side", "query_id", "node_id", "edge_id", "before", region)
    at, done = ends.join(labels.select("side", "query_id", "node_id"), ["side", "query_id", "node_id"]).select("side", "query_id", "node_id", F.array().cast("array<long>").alias("path")), None
    while True:
        key = ["side", "query_id", "region"]
        here = at.join(place.select("node_id", region), "node_id")
        there = labels.join(F.broadcast(here.select(*key).distinct()), key, "left_semi")  # a row for each query and side
        own = renamed(there, key)
        at = cut(own.groupBy(*own.columns[:3]).cogroup(here.groupBy(*key)).applyInArrow(_walk, "side int, query_id long, node_id long, path array<long>"))
        arrived = at.where("node_id is null").select("side", "query_id", "path")
        done = arrived if done is None else done.unionByName(arrived)
        at = at.where("node_id is not null")
        if is_empty(at):
            return done


def solve_relational(g: Graph, queries: DataFrame, method: str = "normal") -> DataFrame:
    """id, path, cost by rounds; queries: id, start_id, end_id, alpha.  Unreachable: null path and cost."""
    overlay = method in ("pch", "pcrp", "prp")
    size = block_nodes(g)
    place = blocks(g.nodes, size)
    n = g.nodes.join(place, "node_id").select("node_id", "partition", "block")
    asked = cut(queries.select("id", "start_id", "end_id", "alpha"))
    bucket = F.pmod(F.xxhash64("id"), F.lit(1 + asked.count() // TOGETHER)).alias("bucket")
    q = cut(asked.join(n.toDF("start_id", "ps", "bs"), "start_id").join(n.toDF("end_id", "pt", "bt"), "end_id").select(F.col("id").cast("long").alias("query_id"), bucket, "start_id", "end_id", F.col("alpha").cast("array<double>").alias("alpha"), "ps", "pt", "bs", "bt"))
    target = F.lit(None).cast("long") if overlay else F.col("end_id").cast("long")
    one = q.select(F.lit(0).alias("side"), "bucket", F.col("bs").alias("block"), "query_id", F.col("start_id").alias("node_id"), "alpha", "ps", "pt", target.alias("target"))
    if overlay:
        one = one.unionByName(q.select(F.lit(1).alias("side"), "bucket", F.col("bt").alias("block"), "query_id", F.col("end_id").alias("node_id"), "alpha", "ps", "pt", target.alias("target")))
    labels = settle(searchable(g, place, method), cut(one.drop("block", "node_id")), one, g.dim, g.mlp_levels)
    if not overlay:
        found = cut(labels.join(q.select("query_id", F.col("end_id").alias("node_id")), ["query_id", "node_id"]).select("query_id", "node_id", "cost"))
        paths = walk_paths(labels, place, found.select(F.lit(0).alias("side"), "query_id", "node_id"), size).select("query_id", "path")
    else:
        both = labels.where("side = 0").select("query_id", "node_id", "cost").join(labels.where("side = 1").select("query_id", "node_id", F.col("cost").alias("rest")), ["query_id", "node_id"])
        found = cut(both.groupBy("query_id").agg(F.min(F.struct((F.col("cost") + F.col("rest")).alias("cost"), "node_id")).alias("x")).select("query_id", "x.node_id", "x.cost"))
        walked = walk_paths(labels, place, found.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("side"), "query_id", "node_id"), size)
        first, second = walked.where("side = 0"), walked.where("side = 1").select("query_id", F.reverse("path").alias("rest"))
        packed = first.join(second, "query_id").select(F.col("query_id").alias("id"), F.concat("path", "rest").alias("path"))
        paths = unpack(g.edges, packed).withColumnRenamed("id", "query_id")
    answered = found.join(paths, "query_id").select(F.col("query_id").alias("id"), "path", "cost")
    return asked.select("id").join(answered, "id", "left").select("id", "path", "cost")


def solve(g: Graph, queries: DataFrame, method: str = "normal", strategy: str = "auto", counters: bool = False) -> DataFrame:
    """id, path (original edge ids), cost of each query; with counters also heap_pops, relaxed_edges and time.

    strategy: ``kernel``, ``relational`` or ``auto``, by the size of the graph's arrays.  Both follow
    the method's rules; ``bi`` is one-way in the relational form, whose rounds serve all queries
    at once.  A name in OWN goes to that function.  Counters belong to the kernel, which refuses a graph that is too large for it.
    """
    if method in OWN:
        return OWN[method](g, queries)
    if method not in METHODS:
        raise ValueError(f"method {method!r} is none of {METHODS}")
    if strategy == "auto":
        strategy = "kernel" if counters or kernel.fits(g) else "relational"
    if strategy == "relational":
        return solve_relational(g, queries, method)
    return kernel.search(g, queries, method, counters)


def path_nodes(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """id, nodes: starts of the path's edges and the end of the last; an empty path has no nodes."""
    steps = paths.select("id", F.posexplode("path").alias("pos", "edge_id")).join(edges.select("edge_id", "src", "dst"), "edge_id")
    listed = steps.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "src", "dst"))).alias("s"))
    nodes = F.concat(F.transform("s", lambda x: x["src"]), F.array(F.element_at("s", -1)["dst"]))
    return paths.select("id").join(listed.select("id", nodes.alias("nodes")), "id", "left").select("id", F.coalesce("nodes", F.array().cast("array<long>")).alias("nodes"))


def path_costs(paths: DataFrame, edges: DataFrame, queries: DataFrame) -> DataFrame:
    """id and the cost recomputed along the path; null where there is no path."""
    steps = paths.where("path is not null").select("id", F.explode("path").alias("edge_id")).join(edges.select("edge_id", "cost"), "edge_id").join(queries.select("id", "alpha"), "id")
    total = steps.groupBy("id").agg(F.sum(dot("cost", "alpha")).alias("total"))
    return paths.select("id", "path").join(total, "id", "left").select("id", F.when(F.col("path").isNotNull(), F.coalesce("total", F.lit(0.0))).alias("path_cost"))


def path_vectors(paths: DataFrame, edges: DataFrame, dim: int) -> DataFrame:
    """id and the cost vector summed along the path."""
    steps = paths.where("path is not null").select("id", F.explode("path").alias("edge_id")).join(edges.select("edge_id", "cost"), "edge_id")
    total = steps.groupBy("id").agg(*[F.sum(F.get("cost", F.lit(i))).alias(f"c{i}") for i in range(dim)])
    return paths.where("path is not null").select("id").join(total, "id", "left").select("id", F.array(*[F.coalesce(f"c{i}", F.lit(0.0)) for i in range(dim)]).alias("cost_vector"))


def unpack(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """id, path with every shortcut replaced by the original edges below it, by rounds of UNPACK_STEPS joins."""
    via = cut(edges.where("via is not null").select("edge_id", "via"))
    at = cut(paths.where("path is not null").select("id", F.posexplode("path").alias("p", "edge_id")).select("id", F.array(F.col("p")).alias("key"), "edge_id"))
    parts = F.when(F.col("via").isNull(), F.array(F.struct("key", "edge_id"))).otherwise(F.array(F.struct(F.concat("key", F.array(F.lit(0))).alias("key"), F.col("via.first").alias("edge_id")), F.struct(F.concat("key", F.array(F.lit(1))).alias("key"), F.col("via.second").alias("edge_id"))))
    while not is_empty(at.join(via.select("edge_id"), "edge_id", "left_semi")):
        for _ in range(UNPACK_STEPS):
            at = at.join(via, "edge_id", "left").select("id", F.explode(parts).alias("x")).select("id", "x.key", "x.edge_id")
        at = cut(at)
    whole = at.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("key", "edge_id"))).alias("s")).select("id", F.transform("s", lambda x: x["edge_id"]).alias("new"))
    return paths.select("id", F.col("path").alias("old")).join(whole, "id", "left").select("id", F.coalesce("new", "old").alias("path"))
