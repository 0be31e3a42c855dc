"""Heap searches over a graph in arrays, run on Arrow batches of queries.

A search keeps, for one direction, the cost and last edge of each labelled node and a heap.
The methods differ in the edges that a node may be left by:

* normal, bi: original edges;
* pch: edges to nodes of the same or a higher rank;
* pcrp: edges of at least the node's query level, the smaller of the levels at which its
  cell differs from the source's and the target's;
* prp: from nodes of level 0 upward in rank, from all others edges of at least the query
  level and level 1.

Equal costs leave the heap by node id, so that counters and paths are the same on every run.
"""

from __future__ import annotations

import heapq
import time
from array import array
from collections.abc import Callable, Iterator
from math import inf, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph

#: Bytes that the arrays of a graph may take in the driver and in each Python worker.
KERNEL_BYTES = 256 << 20
#: Preferences whose weights a worker keeps, eight bytes an edge for each.
KEPT_WEIGHTS = 4


def edge_bytes(dim: int) -> int:
    """Bytes an edge in the arrays: ids, ends, level, parts, out- and in-list, costs, weights."""
    return 8 + 4 * 2 + 1 + 4 * 2 + 4 * 2 + 8 * dim + 8 * KEPT_WEIGHTS


def fits(g: Graph) -> bool:
    """Whether the graph may be held as arrays."""
    return g.edges.count() * edge_bytes(g.dim) <= KERNEL_BYTES


def packed(values: np.ndarray, kind: str) -> array:
    """Numbers without an object for each, faster to read one by one than numpy's."""
    out = array(kind)
    out.frombytes(np.ascontiguousarray(values, np.dtype(kind)).tobytes())
    return out


class Lists:
    """Edge positions by node, in the order of the edge table."""

    def __init__(self, nodes: np.ndarray, keep: np.ndarray, n: int):
        at = np.flatnonzero(keep)
        at = at[np.argsort(nodes[at], kind="stable")]
        self.edges = packed(at, "i")
        self.start = packed(np.searchsorted(nodes[at], np.arange(n + 1)), "i")

    def get(self, v: int) -> array:
        return self.edges[self.start[v] : self.start[v + 1]]


class Arrays:
    """The graph in arrays: nodes and edges by position, edges in the order (src, dst, id), and lists of the edges that a method may use."""

    def __init__(self, edges: dict, nodes: dict, levels: tuple[int, ...]):
        order = np.argsort(nodes["node_id"])
        self.ids = nodes["node_id"][order]
        self.rank, self.partition = nodes["rank"][order], nodes["partition"][order]
        self.node_level = packed(nodes["level"][order], "i")
        self.edge_id, self.cost, self.levels = edges["edge_id"], edges["cost"], levels
        self._src, self._dst = np.searchsorted(self.ids, edges["src"]), np.searchsorted(self.ids, edges["dst"])
        self.src, self.dst, self.level = packed(self._src, "i"), packed(self._dst, "i"), packed(edges["level"], "b")
        by_id = np.argsort(self.edge_id)
        place = lambda x: np.where(x < 0, -1, by_id[np.minimum(np.searchsorted(self.edge_id, x, sorter=by_id), len(by_id) - 1)]) if len(by_id) else x
        self.first, self.second = packed(place(edges["first"]), "i"), packed(place(edges["second"]), "i")
        self.below = [prod(levels[:k]) for k in range(len(levels) + 1)]
        self.lists: dict[str, tuple[Lists, Lists]] = {}

    def node(self, node_id: int | None) -> int:
        """Position of a node, -1 for one that the graph doesn't have."""
        if node_id is None:
            return -1
        at = int(np.searchsorted(self.ids, node_id))
        return at if at < len(self.ids) and self.ids[at] == node_id else -1

    def adjacency(self, method: str) -> tuple[Lists, Lists]:
        """Edge positions by start and by end, of the edges that the method may use from there."""
        if method not in self.lists:
            level = np.frombuffer(self.level, np.int8)
            if method in ("normal", "bi"):
                out = into = np.frombuffer(self.first, np.int32) < 0
            elif method == "pcrp":
                out = into = level >= 0
            else:
                out, into = self.rank[self._src] <= self.rank[self._dst], self.rank[self._dst] <= self.rank[self._src]
                if method == "prp":
                    low = np.frombuffer(self.node_level, np.int32) == 0
                    out, into = np.where(low[self._src], out, level >= 1), np.where(low[self._dst], into, level >= 1)
            self.lists[method] = Lists(self._src, out, len(self.ids)), Lists(self._dst, into, len(self.ids))
        return self.lists[method]

    def differing(self, a: int, b: int) -> int:
        p, q = int(self.partition[a]), int(self.partition[b])
        return next((k for k, x in enumerate(self.below) if p // x == q // x), len(self.levels))

    def unpack(self, path: list[int]) -> list[int]:
        """Ids of the original edges below the edges at some positions."""
        out, todo = [], path[::-1]
        while todo:
            e = todo.pop()
            if self.first[e] < 0:
                out.append(int(self.edge_id[e]))
            else:
                todo += [self.second[e], self.first[e]]
        return out


class Side:
    def __init__(self, start: int, lists: Lists, ends: array):
        self.best, self.last, self.done = {start: 0.0}, {}, set()
        self.heap, self.lists, self.ends = [(0.0, start)], lists, ends

    def head(self) -> float:
        while self.heap and self.heap[0][1] in self.done:
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else inf


class Count:
    """Counters of one search; with ``steps`` also what it visited, in order: ('node', id), ('edge', id), ('meeting', id)."""

    def __init__(self, steps: list | None = None):
        self.pops = self.relaxed = 0
        self.steps = steps


def one_way(a: Arrays, s: int, t: int, w: array, n: Count) -> tuple[list[int], float] | None:
    """Positions of the edges of a best path and its cost."""
    side = Side(s, a.adjacency("normal")[0], a.dst)
    while side.head() < inf:
        d, v = heapq.heappop(side.heap)
        side.done.add(v)
        n.pops += 1
        if n.steps is not None:
            n.steps.append(("node", int(a.ids[v])))
        if v == t:
            path = []
            while v != s:
                i = side.last[v]
                path.append(i)
                v = a.src[i]
            return path[::-1], d
        for i in side.lists.get(v):
            n.relaxed += 1
            if n.steps is not None:
                n.steps.append(("edge", int(a.edge_id[i])))
            u, c = a.dst[i], d + w[i]
            if c < side.best.get(u, inf):
                side.best[u], side.last[u] = c, i
                heapq.heappush(side.heap, (c, u))
    return None


def two_way(a: Arrays, method: str, s: int, t: int, w: array, n: Count) -> tuple[list[int], float] | None:
    out, into = a.adjacency(method)
    f, b = Side(s, out, a.dst), Side(t, into, a.src)
    query_level: dict[int, int] = {}

    def least_level(v: int) -> int:
        if v not in query_level:
            query_level[v] = min(a.differing(v, s), a.differing(v, t))
        return query_level[v]

    overlay = method in ("pcrp", "prp")
    best, meet = (0.0, s) if s == t else (inf, None)
    while True:
        hf, hb = f.head(), b.head()
        # without level or rank rules each side settles true distances, and the sum of the heads bounds what is left
        if (hf + hb if method == "bi" else min(hf, hb)) >= best or min(hf, hb) == inf and (method == "bi" or max(hf, hb) == inf):
            break
        side, other = (f, b) if hf <= hb else (b, f)
        d, v = heapq.heappop(side.heap)
        side.done.add(v)
        n.pops += 1
        if n.steps is not None:
            n.steps.append(("node", int(a.ids[v])))
        low = least_level(v) if overlay and not (method == "prp" and a.node_level[v] == 0) else -2
        for i in side.lists.get(v):
            if a.level[i] < low:
                continue
            n.relaxed += 1
            if n.steps is not None:
                n.steps.append(("edge", int(a.edge_id[i])))
            u, c = side.ends[i], d + w[i]
            if c < side.best.get(u, inf):
                side.best[u], side.last[u] = c, i
                heapq.heappush(side.heap, (c, u))
                if c + other.best.get(u, inf) < best:
                    best, meet = c + other.best[u], u
    if meet is None:
        return None
    if n.steps is not None:
        n.steps.append(("meeting", int(a.ids[meet])))
    path, v = [], meet
    while v != s:
        i = f.last[v]
        path.append(i)
        v = a.src[i]
    path.reverse()
    v = meet
    while v != t:
        i = b.last[v]
        path.append(i)
        v = a.dst[i]
    return path, best


def collect(g: Graph) -> tuple[dict, dict, tuple[int, ...]]:
    """The graph as numpy arrays, if its size allows that."""
    if not fits(g):
        raise ValueError(f"the graph takes over {KERNEL_BYTES} bytes as arrays; the relational strategy has no such bound")
    e = g.edges.select("edge_id", "src", "dst", F.coalesce("level", F.lit(-1)).alias("level"), F.coalesce("via.first", F.lit(-1)).alias("first"), F.coalesce("via.second", F.lit(-1)).alias("second"), *[F.get("cost", F.lit(i)).alias(f"c{i}") for i in range(g.dim)]).toArrow()
    n = g.nodes.select("node_id", "rank", "partition", F.coalesce("level", F.lit(0)).alias("level")).toArrow()
    order = np.lexsort((e.column("edge_id").to_numpy(), e.column("dst").to_numpy(), e.column("src").to_numpy()))
    edges = {c: e.column(c).to_numpy()[order] for c in ("edge_id", "src", "dst", "level", "first", "second")}
    edges["cost"] = np.stack([e.column(f"c{i}").to_numpy()[order].astype(float) for i in range(g.dim)], axis=1)
    return edges, {c: n.column(c).to_numpy() for c in ("node_id", "rank", "partition", "level")}, tuple(g.mlp_levels)


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select(F.col("id").cast("long").alias("id"), F.col("start_id").cast("long").alias("start_id"), F.col("end_id").cast("long").alias("end_id"), F.col("alpha").cast("array<double>").alias("alpha"))


def search(g: Graph, queries: DataFrame, method: str, counters: bool = False) -> DataFrame:
    """id, path, cost; with counters also heap_pops, relaxed_edges and time (nanoseconds of the search alone)."""
    spark = g.edges.sparkSession
    shared = spark.sparkContext.broadcast(collect(g))
    kept: dict[str, Arrays] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "a" not in kept:
            kept["a"] = Arrays(*shared.value)
        a = kept["a"]
        a.adjacency(method)
        find: Callable = (lambda *x: one_way(a, *x)) if method == "normal" else (lambda *x: two_way(a, method, *x))
        weights: dict[tuple, array] = {}
        for batch in batches:
            done = []
            for q in batch.to_pylist():
                alpha = tuple(q["alpha"])
                if alpha not in weights:
                    if len(weights) >= KEPT_WEIGHTS:
                        weights.clear()
                    weights[alpha] = packed(a.cost @ np.array(alpha, float), "d")
                s, t, n = a.node(q["start_id"]), a.node(q["end_id"]), Count()
                began = time.perf_counter_ns()
                found = find(s, t, weights[alpha], n) if s >= 0 and t >= 0 else None
                took = time.perf_counter_ns() - began
                done.append((q["id"], *((None, None) if found is None else (a.unpack(found[0]), found[1])), n.pops, n.relaxed, took))
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], names=["id", "path", "cost", "heap_pops", "relaxed_edges", "time"])

    out = _asked(queries).repartition(spark.sparkContext.defaultParallelism, "id").sortWithinPartitions("alpha", "start_id").mapInArrow(run, "id long, path array<long>, cost double, heap_pops long, relaxed_edges long, time long")
    return out if counters else out.select("id", "path", "cost")


def tree(g: Graph, source: int, alpha: list[float]) -> DataFrame:
    """node_id and cost from one source over the original edges: one search, so one task's work."""
    shared = g.edges.sparkSession.sparkContext.broadcast(collect(g))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            a = Arrays(*shared.value)
            s, w = a.node(source), packed(a.cost @ np.array(alpha, float), "d")
            if s < 0:
                continue
            side = Side(s, a.adjacency("normal")[0], a.dst)
            while side.head() < inf:
                d, v = heapq.heappop(side.heap)
                side.done.add(v)
                for i in side.lists.get(v):
                    u, c = a.dst[i], d + w[i]
                    if c < side.best.get(u, inf):
                        side.best[u] = c
                        heapq.heappush(side.heap, (c, u))
            at = np.fromiter(side.best, np.int64, len(side.best))
            yield pa.RecordBatch.from_arrays([pa.array(a.ids[at]), pa.array(np.fromiter(side.best.values(), float, len(at)))], names=["node_id", "cost"])

    return g.edges.sparkSession.range(0, 1, 1, 1).mapInArrow(run, "node_id long, cost double")


class Resumable:
    """Searches from one source under one preference that go on where the last one stopped; another source or preference starts anew."""

    def __init__(self, a: Arrays):
        self.a, self.of, self.settled = a, None, 0

    def find(self, s: int, t: int, alpha: tuple[float, ...]) -> tuple[list[int], list[float]] | None:
        """Ids of the edges of a best path between two positions, and the sum of their cost vectors."""
        a = self.a
        if self.of != (s, alpha):
            self.of, self.weights = (s, alpha), packed(a.cost @ np.array(alpha, float), "d")
            self.side, self.settled = Side(s, a.adjacency("normal")[0], a.dst), 0
        side, w = self.side, self.weights
        while t not in side.done and side.head() < inf:
            d, v = heapq.heappop(side.heap)
            side.done.add(v)
            self.settled += 1
            for i in side.lists.get(v):
                u, c = a.dst[i], d + w[i]
                if c < side.best.get(u, inf):
                    side.best[u], side.last[u] = c, i
                    heapq.heappush(side.heap, (c, u))
        if t not in side.done:
            return None
        path, total = [], np.zeros(a.cost.shape[1])
        while t != s:
            i = side.last[t]
            path.append(int(a.edge_id[i]))
            total += a.cost[i]
            t = a.src[i]
        return path[::-1], total.tolist()


def vector_paths(g: Graph, queries: DataFrame) -> DataFrame:
    """id, path, cost_vector over original edges; queries of one start and preference share a search."""
    spark = g.edges.sparkSession
    shared = spark.sparkContext.broadcast(collect(g))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search_ = Resumable(Arrays(*shared.value))
        for batch in batches:
            ids, found = [], []
            for q in batch.to_pylist():
                s, t = search_.a.node(q["start_id"]), search_.a.node(q["end_id"])
                ids.append(q["id"])
                found.append(search_.find(s, t, tuple(q["alpha"])) if s >= 0 and t >= 0 else None)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([f and f[0] for f in found], pa.list_(pa.int64())), pa.array([f and f[1] for f in found], pa.list_(pa.float64()))], names=["id", "path", "cost_vector"])

    asked = _asked(queries).repartition(spark.sparkContext.defaultParallelism, "start_id", "alpha").sortWithinPartitions("start_id", "alpha", "id")
    return asked.mapInArrow(run, "id long, path array<long>, cost_vector array<double>")


def trace(g: Graph, queries: DataFrame, method: str) -> DataFrame:
    """id, step, kind, value: the nodes settled, edges relaxed and the meeting node of each search, in order."""
    shared = g.edges.sparkSession.sparkContext.broadcast(collect(g))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = Arrays(*shared.value)
        for batch in batches:
            for q in batch.to_pylist():
                s, t, n, w = a.node(q["start_id"]), a.node(q["end_id"]), Count([]), packed(a.cost @ np.array(q["alpha"], float), "d")
                if s >= 0 and t >= 0:
                    _ = one_way(a, s, t, w, n) if method == "normal" else two_way(a, method, s, t, w, n)
                k = len(n.steps)
                yield pa.RecordBatch.from_arrays([pa.array([q["id"]] * k, pa.int64()), pa.array(range(k), pa.int64()), pa.array([x[0] for x in n.steps], pa.string()), pa.array([x[1] for x in n.steps], pa.int64())], names=["id", "step", "kind", "value"])

    return _asked(queries).mapInArrow(run, "id long, step long, kind string, value long")
