"""Node levels and overlay contraction.

A node's level is the highest level at which an incident edge leaves its cell.  Level by
level, the nodes of that level are contracted: all neighbours of such a node lie in its own
cell of that level, so the cells are contracted side by side, one group of rows each, and a
level takes one shuffle whatever the number of nodes.  Levels with a cell of more than
CELL_EDGES edges, as in a graph without a partitioning, are contracted in rounds instead: each
takes an independent set of all nodes that go, as joins over the edge table, so that no task
holds a cell.

A shortcut u -> w over v is added unless another u -> w edge, or path of two edges that
avoids v, costs at most as much in every component; so the overlay holds a shortest path for
every preference without negative weights.  Shortcuts that a later one is at most as costly
as are dropped; original edges never are.

An edge's level is the highest level at whose start it was still there; shortcuts made and
used up within one level have none; what is there at the end has the number of levels.
Ranks grow with the level and, within a cell, with the order of contraction.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import differing_level, dominates, partition_id
from ..graph import UNRANKED, Graph
from ..session import cut, numbered
from .adjacency import dedup_costs, degrees, shortcut_candidates, skyline

#: Ranks of one level lie below this times the level plus one.
LEVEL_RANKS = 1 << 40
#: Default of ``contract``: a node with more pairs of an in- and an out-edge than this isn't contracted, since with several
#: costs the shortcuts of a dense core multiply.  What is left joins the top level.
STOP_PAIRS = 400
#: Edges of a cell, of some kilobytes in a Python task, up to which a cell is one task's work.
CELL_EDGES = 100_000


def node_levels(g: Graph) -> DataFrame:
    """node_id, level; 0 for nodes without edges."""
    p = g.nodes.select("node_id", "partition")
    ends = g.originals().select("src", "dst").join(p.toDF("src", "p1"), "src").join(p.toDF("dst", "p2"), "dst").withColumn("d", differing_level(F.col("p1"), F.col("p2"), g.mlp_levels))
    top = ends.select(F.explode(F.array("src", "dst")).alias("node_id"), "d").groupBy("node_id").agg(F.max("d").alias("level"))
    return g.nodes.select("node_id").join(top, "node_id", "left").select("node_id", F.coalesce("level", F.lit(0)).cast("int").alias("level"))


def independent_set(nodes: DataFrame, edges: DataFrame, heuristic: str = "h") -> DataFrame:
    """Nodes whose (heuristic, id) is the least in their neighbourhood; nodes: node_id, heuristic.  Self-loops don't count."""
    n = nodes.select("node_id", F.struct(F.col(heuristic), F.col("node_id")).alias("key"))
    both = edges.where("src <> dst").select("src", "dst").union(edges.where("src <> dst").select("dst", "src"))
    least = both.join(n.withColumnRenamed("node_id", "dst"), "dst").groupBy(F.col("src").alias("node_id")).agg(F.min("key").alias("least"))
    return n.join(least, "node_id", "left").where(F.col("least").isNull() | (F.col("key") < F.col("least"))).select("node_id")


def lowest_decile(nodes: DataFrame, heuristic: str = "h") -> DataFrame:
    """The tenth of the nodes with the least (heuristic, id), rounded up; all of at most ten."""
    ranked = numbered(nodes, [heuristic, "node_id"], "__r")
    n = nodes.agg(F.count("*").alias("__n"))
    return ranked.join(F.broadcast(n)).where((F.col("__n") <= 10) | (F.col("__r") < F.ceil(F.col("__n") / 10))).drop("__r", "__n")  # one row


def _contract_cell(rows: pd.DataFrame, stop_pairs: int | None, share: float) -> pd.DataFrame:
    """rows: edges (kind 'e') and nodes to contract (kind 'n') of one cell.  Returns shortcuts and ranks."""
    out: dict[int, dict[int, list]] = {}
    into: dict[int, dict[int, list]] = {}
    order: list = []

    def add(e: dict) -> None:
        out.setdefault(e["src"], {}).setdefault(e["dst"], []).append(e)
        into.setdefault(e["dst"], {}).setdefault(e["src"], []).append(e)

    def drop(e: dict) -> None:
        for lists, a, b in ((out, e["src"], e["dst"]), (into, e["dst"], e["src"])):
            lists[a][b] = [x for x in lists[a][b] if x is not e]
            if not lists[a][b]:
                del lists[a][b]

    todo = set()
    rows = rows.sort_values(["kind", "edge_id", "src"])  # the order of arrival must not matter
    for r in rows.itertuples(index=False):
        if r.kind == "n":
            todo.add(int(r.src))
        elif r.src != r.dst:
            add({"id": int(r.edge_id), "src": int(r.src), "dst": int(r.dst), "cost": tuple(r.cost), "short": bool(r.short)})
    made: list[dict] = []
    size = lambda v: sum(map(len, into.get(v, {}).values())) * sum(map(len, out.get(v, {}).values()))
    keep = math.floor(len(todo) * (1 - share) + 1e-9)
    heap = [(size(v), v) for v in todo]
    heapq.heapify(heap)
    at_most = lambda a, b: all(x <= y for x, y in zip(a, b))
    while heap and len(todo) > keep:
        h, v = heapq.heappop(heap)
        if v not in todo:
            continue
        if (now := size(v)) > h:
            heapq.heappush(heap, (now, v))
            continue
        if stop_pairs is not None and h > stop_pairs:
            break
        todo.remove(v)
        before, after = into.pop(v, {}), out.pop(v, {})
        for u in before:
            out[u].pop(v)
        for w in after:
            into[w].pop(v)
        for u, firsts in before.items():
            for w, seconds in after.items():
                if u == w:
                    continue
                for a in firsts:
                    for b in seconds:
                        cost = tuple(x + y for x, y in zip(a["cost"], b["cost"]))
                        direct = out.get(u, {}).get(w, ())
                        if any(at_most(e["cost"], cost) for e in direct):
                            continue
                        mids = out.get(u, {}).keys() & into.get(w, {}).keys()
                        if any(at_most(tuple(x + y for x, y in zip(e["cost"], f["cost"])), cost) for m in mids for e in out[u][m] for f in into[w][m]):
                            continue
                        for e in [e for e in direct if e["short"] and at_most(cost, e["cost"])]:
                            drop(e)
                            e["dropped"] = True
                        e = {"id": -1 - len(made), "src": u, "dst": w, "cost": cost, "short": True, "first": a["id"], "second": b["id"]}
                        made.append(e)
                        add(e)
        order.append(v)
    cell = int(rows["cell"].iloc[0])
    # a dropped shortcut may be part of one made before it was dropped; it stays, without further use
    data = [("e", cell, e["id"], e["src"], e["dst"], list(e["cost"]), e["first"], e["second"], bool(e.get("dropped"))) for e in made]
    data += [("n", cell, k, v, v, [], 0, 0, False) for k, v in enumerate(order)]
    data += [("l", cell, 0, v, v, [], 0, 0, False) for v in sorted(todo)]
    return pd.DataFrame(data, columns=["kind", "cell", "local", "src", "dst", "cost", "first", "second", "dropped"])


MADE = "kind string, cell long, local long, src long, dst long, cost array<double>, first long, second long, dropped boolean"


def _contract_rounds(rows: DataFrame, going: DataFrame, stop_pairs: int | None, share: float, decile: bool) -> DataFrame:
    """What ``_contract_cell`` gives for all cells of a level, by rounds of independent sets of the nodes with the least number of pairs."""
    edges = cut(rows.where("src <> dst").select("cell", F.col("edge_id").alias("id"), "src", "dst", "cost"))
    todo = cut(going.select("cell", F.col("src").alias("node_id")))
    left = todo.count()
    keep, made, gone, n, made_n = math.floor(left * (1 - share) + 1e-9), None, None, 0, 0
    while left > keep:
        degree = degrees(todo.select("node_id"), edges).join(todo, "node_id")
        size = degree.select("cell", "node_id", (F.col("out_degree").cast("long") * F.col("in_degree")).alias("h"))
        size = cut(size if stop_pairs is None else size.where(F.col("h") <= stop_pairs))
        some = cut(lowest_decile(size)) if decile else size
        taken = cut(independent_set(some, edges).join(todo, "node_id"))
        found = taken.count()
        if not found:
            break
        nodes = taken.select(F.lit("n").alias("kind"), "cell", F.lit(n).cast("long").alias("local"), F.col("node_id").alias("src"), F.col("node_id").alias("dst"))
        gone = nodes if gone is None else gone.unionByName(nodes)
        ids = taken.select("node_id")
        rest = cut(edges.join(ids.toDF("src"), "src", "left_anti").join(ids.toDF("dst"), "dst", "left_anti").select("cell", "id", "src", "dst", "cost"))
        new = skyline(shortcut_candidates(edges.withColumnRenamed("id", "edge_id"), ids), "via_node")
        witness = rest.groupBy("src", "dst").agg(F.collect_list("cost").alias("known"))
        beaten = F.exists("known", lambda y: dominates(y, F.col("cost")))
        new = new.join(witness, ["src", "dst"], "left").where(F.col("known").isNull() | ~beaten).drop("known").join(taken.select(F.col("node_id").alias("via_node"), "cell"), "via_node")
        new = cut(numbered(new, ["src", "dst", "via_node", "first", "second"], "k").select("cell", (-1 - made_n - F.col("k")).alias("id"), "src", "dst", "cost", "first", "second"))
        made_n += new.count()
        made = new if made is None else made.unionByName(new)
        edges = cut(rest.unionByName(new.select("cell", "id", "src", "dst", "cost")))
        todo = cut(todo.join(ids, "node_id", "left_anti").select("cell", "node_id"))
        left, n = left - found, n + 1
    none = [F.array().cast("array<double>").alias("cost"), F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("second"), F.lit(False).alias("dropped")]
    out = todo.select(F.lit("l").alias("kind"), "cell", F.lit(0).cast("long").alias("local"), F.col("node_id").alias("src"), F.col("node_id").alias("dst"), *none)
    if gone is not None:
        out = out.unionByName(gone.select("*", *none))
    if made is not None:
        out = out.unionByName(made.select(F.lit("e").alias("kind"), "cell", F.col("id").alias("local"), "src", "dst", "cost", "first", "second", F.lit(False).alias("dropped")))
    return out


def contract(g: Graph, stop_pairs: int | None = STOP_PAIRS, share: float = 1.0, cell_edges: int = CELL_EDGES, decile: bool = False) -> Graph:
    """The graph with node levels, ranks and the overlay's shortcuts.

    stop_pairs: nodes with more pairs of an in- and an out-edge stay (None: all go).  share: the part of
    each cell's (in rounds, of each level's) nodes that goes.  cell_edges: beyond this a level is contracted in rounds;
    decile: a round then takes from the tenth of the nodes with the fewest pairs only.
    """
    levels = g.mlp_levels
    nodes = cut(g.nodes.drop("level").join(node_levels(g), "node_id"))
    live = g.originals().select("edge_id", "src", "dst", "cost", F.lit(None).cast("int").alias("level"), "via")
    done, ranks = None, None
    for level in range(len(levels)):
        info = nodes.select("node_id", partition_id(F.col("partition"), level, levels).alias("cell"), (F.col("level") == level).alias("goes"))
        live = cut(live.withColumn("level", F.lit(level)).join(info.toDF("src", "c1", "g1"), "src").join(info.toDF("dst", "c2", "g2"), "dst"))
        # only what can touch a node that goes: its cell's edges
        rows = live.where("c1 = c2").select(F.lit("e").alias("kind"), F.col("c1").alias("cell"), "edge_id", "src", "dst", "cost", F.col("via").isNotNull().alias("short"))
        going = info.where("goes").select(F.lit("n").alias("kind"), "cell", F.lit(0).cast("long").alias("edge_id"), F.col("node_id").alias("src"), F.col("node_id").alias("dst"), F.array().cast("array<double>").alias("cost"), F.lit(False).alias("short"))
        largest = rows.groupBy("cell").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if largest > cell_edges:
            made = cut(_contract_rounds(rows, going, stop_pairs, share, decile))
        else:
            made = cut(rows.unionByName(going).groupBy("cell").applyInPandas(lambda cell: _contract_cell(cell, stop_pairs, share), MADE))
        # nodes that are left go up; the edges around them stay
        left = made.where("kind = 'l'").select(F.col("src").alias("node_id"), F.lit(len(levels)).alias("up"))
        nodes = cut(nodes.join(left, "node_id", "left").withColumn("level", F.coalesce("up", "level")).drop("up"))
        rank = made.where("kind = 'n'").select(F.col("src").alias("node_id"), (F.lit(level * LEVEL_RANKS) + F.col("local")).alias("rank"))
        ranks = rank if ranks is None else ranks.unionByName(rank)
        first_id = (live if done is None else live.select("edge_id").union(done.select("edge_id"))).agg(F.coalesce(F.max("edge_id"), F.lit(-1)).alias("m")).first()[0] + 1
        short = cut(numbered(made.where("kind = 'e'"), ["cell", F.col("local").desc()], "n").withColumn("edge_id", F.col("n") + first_id))
        ids = short.select("cell", "local", "edge_id")
        by = lambda c: ids.toDF("cell", c, f"{c}_id")
        short = short.join(by("first"), ["cell", "first"], "left").join(by("second"), ["cell", "second"], "left").select(
            "edge_id", "src", "dst", "cost", "dropped", F.struct(F.coalesce("first_id", "first").alias("first"), F.coalesce("second_id", "second").alias("second")).alias("via")
        )
        goes = nodes.where(F.col("level") == level).select("node_id")
        flagged = short.join(goes.withColumn("s", F.lit(True)).withColumnRenamed("node_id", "src"), "src", "left").join(goes.withColumn("t", F.lit(True)).withColumnRenamed("node_id", "dst"), "dst", "left").withColumn("used", F.col("dropped") | F.coalesce("s", F.lit(False)) | F.coalesce("t", F.lit(False)))
        flagged = cut(flagged.select("edge_id", "src", "dst", "cost", F.lit(None).cast("int").alias("level"), "via", "used"))
        ends = live.drop("g1", "g2").join(goes.withColumn("g1", F.lit(True)).withColumnRenamed("node_id", "src"), "src", "left").join(goes.withColumn("g2", F.lit(True)).withColumnRenamed("node_id", "dst"), "dst", "left").na.fill(False, ["g1", "g2"])
        gone = ends.where("g1 or g2").select("edge_id", "src", "dst", "cost", "level", "via").unionByName(flagged.where("used").drop("used"))
        done = cut(gone if done is None else done.unionByName(gone))
        # of shortcuts made alike the first stays
        live = cut(ends.where("not (g1 or g2)").select("edge_id", "src", "dst", "cost", "level", "via").unionByName(dedup_costs(flagged.where("not used").drop("used"))))
    edges = cut(live.withColumn("level", F.lit(len(levels))).unionByName(done))
    nodes = cut(nodes.drop("rank").join(ranks, "node_id", "left").withColumn("rank", F.coalesce("rank", F.lit(UNRANKED))).select("node_id", "lat", "lng", "rank", "partition", "level"))
    return g.with_(nodes=nodes, edges=edges)


def contracted_share(g: Graph) -> DataFrame:
    """level, n and the share of all nodes at or below the level."""
    n = g.nodes.groupBy("level").agg(F.count("*").alias("n"))
    so_far = Window.orderBy("level").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row a level
    return n.withColumn("share", F.sum("n").over(so_far) / F.sum("n").over(Window.partitionBy(F.lit(1))))
