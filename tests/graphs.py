"""Small graphs, and answers worked out the plain way."""

import random
from math import inf

from pyspark.sql import functions as F

from routeloom.graph import Graph, edge_table, node_table


def some_edges(seed, nodes=10, count=22, dim=1):
    """Random edges with whole costs between nodes 0, 1, ...; one node is left without out-edges."""
    r = random.Random(seed)
    return [(r.randrange(nodes - 1), r.randrange(nodes), [float(r.randint(1, 9)) for _ in range(dim)]) for _ in range(count)]


#: Two ways from 0 to 5: one is cheap in the first cost, the other in the second.
FORK = [(0, 1, [1, 5]), (1, 3, [1, 5]), (3, 5, [1, 5]), (0, 2, [4, 1]), (2, 4, [4, 1]), (4, 5, [2, 1])]


def distances(edges, start, alpha):
    """node -> least cost, by relaxing every edge until nothing changes."""
    best = {start: 0.0}
    while True:
        new = dict(best)
        for a, b, c in edges:
            w = new.get(a, inf) + sum(x * y for x, y in zip(c, alpha))
            if w < new.get(b, inf):
                new[b] = w
        if new == best:
            return best
        best = new


def build(spark, edges, partitions=None, levels=(1,), extra_nodes=()):
    """Edges get ids in the order (src, dst)."""
    rows = sorted((a, b, [float(x) for x in (c if isinstance(c, list) else [c])]) for a, b, c in edges)
    dim = len(rows[0][2])
    e = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "edge_id long, src long, dst long, cost array<double>")
    ids = sorted({x for r in rows for x in r[:2]} | set(extra_nodes))
    n = spark.createDataFrame([(v, (partitions or {}).get(v, 0)) for v in ids], "node_id long, partition long")
    return Graph(node_table(n), edge_table(e), dim, (), tuple(levels))


def queries(spark, rows):
    return spark.createDataFrame([(i, s, t, [float(x) for x in a]) for i, (s, t, a) in enumerate(rows)], "id long, start_id long, end_id long, alpha array<double>")


def grid_graph(spark, side, seed=1, dim=2):
    """A side x side grid both ways with hashed whole costs and cells of 2 x 2 in 4 x 4."""
    r = random.Random(seed)
    edges, cells = [], {}
    for y in range(side):
        for x in range(side):
            v = y * side + x
            cells[v] = ((y // 4) * ((side + 3) // 4) + x // 4) * 4 + (y % 4 // 2) * 2 + x % 4 // 2
            for w in ([v + 1] if x + 1 < side else []) + ([v + side] if y + 1 < side else []):
                for a, b in ((v, w), (w, v)):
                    edges.append((a, b, [float(r.randint(1, 20)) for _ in range(dim)]))
    blocks = ((side + 3) // 4) ** 2
    return build(spark, edges, cells, (4, blocks))


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


__all__ = ["F", "FORK", "build", "distances", "grid_graph", "queries", "rows", "some_edges"]
