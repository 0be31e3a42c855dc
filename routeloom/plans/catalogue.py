"""Queries over the provided tables, one for each operator, with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import all_partition_ids, differing_level, dot, haversine_km, normalise_preference
from ..graph import Graph
from ..operators import adjacency, components, contraction, evaluation, kernel, partitioners, paths, spatial
from ..session import cut
from ..sources import derived, queries as io
from ..sources.derived import geo_graph, part_graph, points, trade_graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Dyadic preferences: sums of whole costs are exact in any order.
BALANCED, SHORT, FLAT = (0.5, 0.25, 0.25), (1.0, 0.0, 0.0), (0.25, 0.5, 0.25)

GEO = """
n AS (SELECT vec_id AS node_id, CAST(floor((CAST(embedding[1] AS DOUBLE) + 1) * 10000) AS BIGINT) AS y,
    CAST(floor((CAST(embedding[2] AS DOUBLE) + 1) * 10000) AS BIGINT) AS x,
    CAST(floor((CAST(embedding[3] AS DOUBLE) + 1) * 10000) AS BIGINT) AS z FROM embeddings),
nodes AS (SELECT node_id, y / 200.0::DOUBLE - 50 AS lat, x / 200.0::DOUBLE - 50 AS lng,
    ((ty // 2) * 2 + tx // 2) * 4 + (ty % 2) * 2 + tx % 2 AS partition
  FROM (SELECT *, least(y // 5000, 3) AS ty, least(x // 5000, 3) AS tx FROM n)),
knn AS (SELECT f, t FROM (SELECT a.node_id AS f, b.node_id AS t,
    row_number() OVER (PARTITION BY a.node_id ORDER BY (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y), b.node_id) AS r
  FROM n a JOIN n b ON a.node_id <> b.node_id) WHERE r <= 4),
pairs AS (SELECT f, t FROM knn UNION SELECT t, f FROM knn),
edges AS (SELECT row_number() OVER (ORDER BY f, t) - 1 AS edge_id, f AS src, t AS dst,
    floor(sqrt(CAST((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) AS DOUBLE))) + 1::DOUBLE AS c0,
    CAST(greatest(b.z - a.z, 0) AS DOUBLE) AS c1, 100::DOUBLE AS c2
  FROM pairs JOIN n a ON a.node_id = f JOIN n b ON b.node_id = t),
plevel AS (SELECT e.*, p.partition AS p1, q.partition AS p2,
    CASE WHEN p.partition = q.partition THEN 0 WHEN p.partition // 4 = q.partition // 4 THEN 1 ELSE 2 END AS diff
  FROM edges e JOIN nodes p ON p.node_id = src JOIN nodes q ON q.node_id = dst),
nlevel AS (SELECT node_id, CAST(coalesce(max(diff), 0) AS INTEGER) AS level FROM nodes LEFT JOIN
    (SELECT src AS node_id, diff FROM plevel UNION ALL SELECT dst, diff FROM plevel) USING (node_id) GROUP BY node_id)"""
BATCH = """
q AS (SELECT node_id AS id, node_id AS s, (node_id * 37 + 11) % (SELECT count(*) FROM n) AS t,
    CASE node_id % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 ELSE 0.25 END AS a0, CASE node_id % 3 WHEN 0 THEN 0.25 WHEN 1 THEN 0.0 ELSE 0.5 END AS a1,
    CASE node_id % 3 WHEN 1 THEN 0.0 ELSE 0.25 END AS a2 FROM n WHERE node_id < 24)"""


def with_geo(body: str, more: str = "") -> str:
    return f"WITH {GEO}{more} {body}"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def sssp_sql(alpha: tuple[float, ...]) -> str:
    w = " + ".join(f"c{i} * {a}::DOUBLE" for i, a in enumerate(alpha))
    return f"""WITH RECURSIVE {GEO}, e AS (SELECT src, dst, {w} AS w FROM edges),
d AS (SELECT CAST(0 AS BIGINT) AS node_id, CAST(0 AS DOUBLE) AS cost) , dist(node_id, cost) USING KEY (node_id) AS (
  SELECT node_id, cost FROM d
  UNION
  SELECT x.node_id, x.cost FROM (SELECT e.dst AS node_id, min(r.cost + e.w) AS cost FROM dist r JOIN e ON e.src = r.node_id GROUP BY e.dst) x
    LEFT JOIN recurring.dist o ON o.node_id = x.node_id WHERE o.cost IS NULL OR x.cost < o.cost)
SELECT node_id, cost FROM dist"""


BATCH_SQL = f"""WITH RECURSIVE {GEO}, {BATCH}, dist(id, node_id, cost) USING KEY (id, node_id) AS (
  SELECT id, s AS node_id, CAST(0 AS DOUBLE) AS cost FROM q
  UNION
  SELECT x.id, x.node_id, x.cost FROM (SELECT r.id, e.dst AS node_id, min(r.cost + (e.c0 * q.a0 + e.c1 * q.a1 + e.c2 * q.a2)::DOUBLE) AS cost
      FROM dist r JOIN q ON q.id = r.id JOIN edges e ON e.src = r.node_id GROUP BY r.id, e.dst) x
    LEFT JOIN recurring.dist o ON o.id = x.id AND o.node_id = x.node_id WHERE o.cost IS NULL OR x.cost < o.cost)
SELECT q.id, dist.cost FROM q LEFT JOIN dist ON dist.id = q.id AND dist.node_id = q.t"""


def batch(g: Graph) -> DataFrame:
    """24 fixed queries with three preferences."""
    n = g.nodes.agg(F.count("*").alias("n"))
    alpha = F.when(F.col("id") % 3 == 0, F.array(*map(F.lit, BALANCED))).when(F.col("id") % 3 == 1, F.array(*map(F.lit, SHORT))).otherwise(F.array(*map(F.lit, FLAT)))
    return g.nodes.where("node_id < 24").join(n).select(F.col("node_id").alias("id"), F.col("node_id").alias("start_id"), ((F.col("node_id") * 37 + 11) % F.col("n")).alias("end_id")).withColumn("alpha", alpha)


_overlays: dict[tuple[str, str], Graph] = {}


def overlay(spark: SparkSession, sf_dir: str) -> Graph:
    """The contracted geo graph; kept for the session once made."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _overlays:
        _overlays.clear()
        _overlays[key] = contraction.contract(geo_graph(spark, sf_dir))
    return _overlays[key]


def forget() -> None:
    """Drop the graphs kept for the session, so that the next query starts from the tables."""
    derived.forget()
    _overlays.clear()


# --- adjacency -------------------------------------------------------------------------


@query("geo_edges", with_geo("SELECT edge_id, src, dst, c0, c1, c2 FROM edges"))
def geo_edges(spark, sf_dir):
    return geo_graph(spark, sf_dir).edges.select("edge_id", "src", "dst", *[F.col("cost")[i].alias(f"c{i}") for i in range(3)])


@query("trade_edges", """SELECT CAST(s_nationkey AS BIGINT) AS src, CAST(c_nationkey AS BIGINT) AS dst, CAST(count(*) AS DOUBLE) AS lines, sum(l_quantity) AS quantity
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2""")
def trade_edges(spark, sf_dir):
    return trade_graph(spark, sf_dir).edges.select("src", "dst", F.col("cost")[0].alias("lines"), F.col("cost")[1].alias("quantity"))


PART = """s AS (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS dst FROM lineitem),
p AS (SELECT src, dst, CAST(count(*) AS DOUBLE) AS times FROM s WHERE dst IS NOT NULL AND src <> dst GROUP BY 1, 2)"""


@query("part_edges", f"WITH {PART} SELECT src, dst, times FROM p")
def part_edges(spark, sf_dir):
    return part_graph(spark, sf_dir, with_ids=False).edges.select("src", "dst", F.col("cost")[0].alias("times"))


@query("part_degrees", f"WITH {PART} SELECT node_id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o + i) AS BIGINT) AS degree FROM (SELECT src AS node_id, 1 AS o, 0 AS i FROM p UNION ALL SELECT dst, 0, 1 FROM p) GROUP BY node_id")
def part_degrees(spark, sf_dir):
    g = part_graph(spark, sf_dir, with_ids=False)
    return adjacency.degrees(g.nodes, g.edges)


@query("degrees", with_geo("SELECT node_id, (SELECT count(*) FROM edges WHERE src = node_id) AS out_degree, (SELECT count(*) FROM edges WHERE dst = node_id) AS in_degree, (SELECT count(*) FROM edges WHERE src = node_id) + (SELECT count(*) FROM edges WHERE dst = node_id) AS degree FROM nodes"))
def degrees(spark, sf_dir):
    g = geo_graph(spark, sf_dir)
    return adjacency.degrees(g.nodes, g.edges)


@query("offsets", with_geo('SELECT node_id, (SELECT count(*) FROM edges WHERE src < node_id) AS "offset", (SELECT count(*) FROM edges WHERE src = node_id) AS n FROM nodes'))
def offsets(spark, sf_dir):
    g = geo_graph(spark, sf_dir)
    return adjacency.offsets(g.nodes, g.edges)


@query("targets", f"WITH {PART} SELECT DISTINCT src AS node_id, dst AS neighbour FROM p")
def targets(spark, sf_dir):
    return adjacency.targets(part_graph(spark, sf_dir, with_ids=False).edges)


@query("neighbour_counts", f"WITH {PART} SELECT node_id, count(*) AS n FROM (SELECT src AS node_id, dst AS m FROM p UNION SELECT dst, src FROM p) GROUP BY node_id")
def neighbour_counts(spark, sf_dir):
    return adjacency.neighbours(part_graph(spark, sf_dir, with_ids=False).edges).groupBy("node_id").agg(F.count("*").alias("n"))


@query("incident_edges", with_geo("SELECT src AS node_id, edge_id, true AS outgoing FROM edges UNION ALL SELECT dst, edge_id, false FROM edges"))
def incident_edges(spark, sf_dir):
    g = geo_graph(spark, sf_dir)
    return adjacency.incident_edges(g.edges, g.nodes)


@query("scalarised", with_geo("SELECT edge_id, c0 * 0.5::DOUBLE + c1 * 0.25::DOUBLE + c2 * 0.25::DOUBLE AS balanced, c0 AS short, c0 * 0.25::DOUBLE + c1 * 0.5::DOUBLE + c2 * 0.25::DOUBLE AS flat FROM edges"))
def scalarised(spark, sf_dir):
    return geo_graph(spark, sf_dir).edges.select("edge_id", *[dot("cost", list(a)).alias(n) for n, a in (("balanced", BALANCED), ("short", SHORT), ("flat", FLAT))])


@query("bidirected", f"WITH {PART} SELECT src, dst FROM p UNION SELECT dst, src FROM p")
def bidirected(spark, sf_dir):
    return adjacency.bidirected(part_graph(spark, sf_dir, with_ids=False).edges)


@query("restricted_edges", with_geo("SELECT edge_id, src, dst FROM edges WHERE src % 3 <> 0 AND dst % 3 <> 0"))
def restricted_edges(spark, sf_dir):
    g = geo_graph(spark, sf_dir)
    return adjacency.restrict(g.edges, g.nodes.where("node_id % 3 <> 0")).select("edge_id", "src", "dst")


@query("renumbered", with_geo("""SELECT i.k AS src, j.k AS dst, c0 FROM edges JOIN m i ON src = i.node_id JOIN m j ON dst = j.node_id""",
    ", m AS (SELECT node_id, row_number() OVER (ORDER BY level, degree, node_id) - 1 AS k FROM (SELECT node_id, level, (SELECT count(*) FROM edges WHERE src = node_id OR dst = node_id) AS degree FROM nlevel))"))
def renumbered(spark, sf_dir):
    g = geo_graph(spark, sf_dir)
    d = adjacency.degrees(g.nodes, g.edges).select("node_id", "degree")
    nodes = g.nodes.drop("level").join(contraction.node_levels(g), "node_id").join(d, "node_id")
    return adjacency.renumber(nodes, g.edges, ["level", "degree", "node_id"])[1].select("src", "dst", F.col("cost")[0].alias("c0"))


@query("shortcut_candidates", with_geo("SELECT e.dst AS via_node, e.src, f.dst, e.c0 + f.c0 AS c0, e.c1 + f.c1 AS c1, e.c2 + f.c2 AS c2, e.edge_id AS first, f.edge_id AS second FROM edges e JOIN edges f ON e.dst = f.src WHERE e.src <> f.dst"))
def shortcut_candidates(spark, sf_dir):
    g = geo_graph(spark, sf_dir)
    return adjacency.shortcut_candidates(g.edges, g.nodes).select("via_node", "src", "dst", *[F.col("cost")[i].alias(f"c{i}") for i in range(3)], "first", "second")


@query("undominated_candidates", with_geo("""SELECT via_node, src, dst, c0, c1, c2 FROM c WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.src = c.src AND d.dst = c.dst AND d.c0 <= c.c0 AND d.c1 <= c.c1 AND d.c2 <= c.c2
  AND (d.c0 < c.c0 OR d.c1 < c.c1 OR d.c2 < c.c2 OR d.via_node < c.via_node))""",
    ", c AS (SELECT e.dst AS via_node, e.src, f.dst, e.c0 + f.c0 AS c0, e.c1 + f.c1 AS c1, e.c2 + f.c2 AS c2 FROM edges e JOIN edges f ON e.dst = f.src WHERE e.src <> f.dst)"))
def undominated_candidates(spark, sf_dir):
    g = geo_graph(spark, sf_dir)
    c = adjacency.shortcut_candidates(g.edges, g.nodes).select("via_node", "src", "dst", "cost")
    return adjacency.skyline(c, "via_node").select("via_node", "src", "dst", *[F.col("cost")[i].alias(f"c{i}") for i in range(3)])


@query("used_edges", with_geo("SELECT (SELECT count(*) FROM nodes) AS nodes, count(*) AS edges, count(*) AS normal_edges, count(*) AS pch_edges, CAST(0 AS BIGINT) AS pcrp_edges, CAST(0 AS BIGINT) AS prp_edges FROM edges"))
def used_edges(spark, sf_dir):
    return adjacency.used_edges(geo_graph(spark, sf_dir))


@query("overlay_info")
def overlay_info(spark, sf_dir):
    return adjacency.used_edges(overlay(spark, sf_dir))


# --- preferences and workloads -----------------------------------------------------------


@query("alpha_sweep", "SELECT i / 8.0::DOUBLE AS a0, j / 8.0::DOUBLE AS a1, k / 8.0::DOUBLE AS a2 FROM range(9) a(i), range(9) b(j), range(9) c(k) WHERE i + j + k = 8")
def alpha_sweep(spark, sf_dir):
    return io.alpha_sweep(spark, 3, 8).select(*[F.col("alpha")[i].alias(f"a{i}") for i in range(3)])


@query("normalised_preferences", f"WITH {GEO} SELECT node_id, CASE WHEN s = 0 THEN 1.0::DOUBLE / 3 ELSE a / s END AS a0, CASE WHEN s = 0 THEN 1.0::DOUBLE / 3 ELSE b / s END AS a1, CASE WHEN s = 0 THEN 1.0::DOUBLE / 3 ELSE c / s END AS a2 FROM (SELECT *, a + b + c AS s FROM (SELECT node_id, CAST(x % 4 AS DOUBLE) AS a, CAST(y % 4 AS DOUBLE) AS b, CAST(z % 4 AS DOUBLE) AS c FROM n))")
def normalised_preferences(spark, sf_dir):
    raw = points(spark, sf_dir).select("node_id", F.array(*[(F.col(c) % 4).cast("double") for c in "xyz"]).alias("a"))
    return raw.select("node_id", normalise_preference(F.col("a")).alias("a")).select("node_id", *[F.col("a")[i].alias(f"a{i}") for i in range(3)])


@query("random_queries")
def random_queries(spark, sf_dir):
    return io.random_queries(geo_graph(spark, sf_dir), 1000)


# --- paths ---------------------------------------------------------------------------------


@query("sssp_balanced", sssp_sql(BALANCED))
def sssp_balanced(spark, sf_dir):
    return paths.sssp(geo_graph(spark, sf_dir), 0, list(BALANCED))


@query("sssp_short", sssp_sql(SHORT))
def sssp_short(spark, sf_dir):
    return paths.sssp(geo_graph(spark, sf_dir), 0, list(SHORT))


@query("sssp_flat", sssp_sql(FLAT))
def sssp_flat(spark, sf_dir):
    return paths.sssp(geo_graph(spark, sf_dir), 0, list(FLAT))


@query("batch_relational", BATCH_SQL)
def batch_relational(spark, sf_dir):
    g = geo_graph(spark, sf_dir)
    return paths.solve(g, batch(g), strategy="relational").select("id", "cost")


for _method in paths.METHODS:

    @query(f"batch_{_method}", BATCH_SQL)
    def batch_method(spark, sf_dir, method=_method):
        g = geo_graph(spark, sf_dir) if method in ("normal", "bi") else overlay(spark, sf_dir)
        return paths.solve(g, batch(g), method).select("id", "cost")


for _method in paths.METHODS[2:]:

    @query(f"batch_{_method}_relational", BATCH_SQL)
    def batch_overlay_relational(spark, sf_dir, method=_method):
        g = overlay(spark, sf_dir)
        return paths.solve(g, batch(g), method, "relational").select("id", "cost")


@query("sssp_relational", sssp_sql(BALANCED))
def sssp_relational(spark, sf_dir):
    return paths.sssp(geo_graph(spark, sf_dir), 0, list(BALANCED), "relational")


@query("route_workload")
def route_workload(spark, sf_dir):
    """A thousand random queries, snapped by position and answered on the overlay."""
    g = overlay(spark, sf_dir)
    q = spatial.snap(io.random_queries(g, 1000), g.nodes, spatial.grid_bounds(g.nodes))
    return paths.solve(g, q, "prp").select("id", "path", "cost")


@query("path_costs", BATCH_SQL.replace("dist.cost FROM q", "dist.cost AS path_cost FROM q"))
def path_costs(spark, sf_dir):
    g = geo_graph(spark, sf_dir)
    q = batch(g)
    return paths.path_costs(paths.solve(overlay(spark, sf_dir), q, "prp"), g.edges, q)


@query("path_nodes")
def path_nodes(spark, sf_dir):
    g = geo_graph(spark, sf_dir)
    return paths.path_nodes(paths.solve(g, batch(g)), g.edges)


@query("path_vectors")
def path_vectors(spark, sf_dir):
    g = geo_graph(spark, sf_dir)
    return paths.path_vectors(paths.solve(g, batch(g)), g.edges, g.dim)


@query("path_vector_costs", BATCH_SQL.replace("dist.cost FROM q LEFT JOIN", "dist.cost AS weighted FROM q JOIN"))
def path_vector_costs(spark, sf_dir):
    """The cost vectors of best paths, weighted: whichever of equal paths was taken."""
    g = geo_graph(spark, sf_dir)
    q = batch(g)
    return paths.path_vectors(paths.solve(g, q), g.edges, g.dim).join(q, "id").select("id", dot("cost_vector", "alpha").alias("weighted"))


@query("vector_path_costs", BATCH_SQL.replace("dist.cost FROM q LEFT JOIN", "dist.cost AS weighted FROM q JOIN"))
def vector_path_costs(spark, sf_dir):
    """Cost vectors of searches that go on from one query to the next, weighted."""
    g = geo_graph(spark, sf_dir)
    q = batch(g)
    return kernel.vector_paths(g, q).where("path is not null").join(q, "id").select("id", dot("cost_vector", "alpha").alias("weighted"))


@query("mean_differences", """WITH t AS (SELECT event_type AS method, user_id % 4 AS setting, CAST(floor(value * 1000) AS BIGINT) AS time FROM events), m AS (SELECT method, setting, avg(time) / 1000000 AS ms FROM t GROUP BY 1, 2)
SELECT setting, max(ms) FILTER (method = 'click') - max(ms) FILTER (method = 'view') AS difference_ms FROM m WHERE method IN ('click', 'view') GROUP BY setting""")
def mean_differences(spark, sf_dir):
    return evaluation.difference_of_means(_timings(spark, sf_dir), "click", "view")


@query("method_labels", "SELECT event_type, upper(event_type) AS capitals, upper(event_type[1]) || lower(event_type[2:]) AS label, count(*) AS n FROM events GROUP BY event_type")
def method_labels(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n")).select("event_type", evaluation.label("event_type", upper=True).alias("capitals"), evaluation.label("event_type").alias("label"), "n")


@query("least_ranks", with_geo("SELECT 9223372036854775807 AS least"))
def least_ranks(spark, sf_dir):
    return adjacency.least_rank_of_level_one(geo_graph(spark, sf_dir))


@query("timed_methods", "SELECT method, 'overlay' AS setting, CAST(24 AS BIGINT) AS n FROM (VALUES ('normal'), ('bi'), ('pch'), ('pcrp'), ('prp')) v(method)")
def timed_methods(spark, sf_dir):
    """Searches that were timed and counted on the overlay, by method."""
    g = overlay(spark, sf_dir)
    t = evaluation.timed(g, batch(g), paths.METHODS, "overlay")
    return t.where("time > 0 and heap_pops > 0").groupBy("method", "setting").agg(F.count("*").alias("n"))


@query("path_node_checks", BATCH_SQL.replace("q.id, dist.cost FROM", "q.id, CASE WHEN dist.cost IS NOT NULL AND s <> t THEN s END AS first_node, CASE WHEN dist.cost IS NOT NULL AND s <> t THEN t END AS last_node, CAST(0 AS BIGINT) AS broken, dist.cost AS least FROM"))
def path_node_checks(spark, sf_dir):
    """Ends of the node paths, steps that are no edge, and the cost by the cheapest edge of each step."""
    g = geo_graph(spark, sf_dir)
    q = batch(g)
    p = cut(paths.solve(g, q))
    n = cut(paths.path_nodes(p, g.edges))
    steps = n.select("id", F.posexplode(F.arrays_zip(F.slice("nodes", 1, F.greatest(F.size("nodes") - 1, F.lit(0))).alias("src"), F.slice("nodes", 2, F.greatest(F.size("nodes") - 1, F.lit(0))).alias("dst"))).alias("pos", "x")).select("id", "pos", "x.src", "x.dst").join(q.select("id", "alpha"), "id")
    cheapest = steps.join(g.edges.select("src", "dst", "cost"), ["src", "dst"], "left").groupBy("id", "pos").agg(F.min(dot("cost", "alpha")).alias("w"))
    total = cheapest.groupBy("id").agg(F.sum("w").alias("w"), F.sum(F.col("w").isNull().cast("long")).alias("broken"))
    least = F.when(F.col("path").isNotNull(), F.coalesce("w", F.lit(0.0)))
    return p.select("id", "path").join(n, "id").join(total, "id", "left").select("id", F.get("nodes", F.lit(0)).alias("first_node"), F.when(F.size("nodes") > 0, F.element_at("nodes", -1)).alias("last_node"), F.coalesce("broken", F.lit(0)).cast("long").alias("broken"), least.alias("least"))


@query("search_counters")
def search_counters(spark, sf_dir):
    g = overlay(spark, sf_dir)
    q, out = batch(g), None
    for m in paths.METHODS:
        one = paths.solve(g, q, m, counters=True).select(F.lit(m).alias("method"), "heap_pops", "relaxed_edges")
        out = one if out is None else out.unionByName(one)
    return evaluation.mean_counters(out)


@query("search_traces")
def search_traces(spark, sf_dir):
    g = overlay(spark, sf_dir)
    return kernel.trace(g, batch(g), "prp")


def hops_sql(start: str, edges: str, limit: str = "") -> str:
    return f"""WITH RECURSIVE {GEO}, e AS ({edges}), h(node_id, hop, core) USING KEY (node_id) AS (
  {start}
  UNION
  SELECT e.dst, min(r.hop) + 1, arg_min(r.core, CASE r.core WHEN 499 THEN 0 WHEN 3 THEN 1 ELSE 2 END) FROM h r JOIN e ON e.src = r.node_id LEFT JOIN recurring.h o ON o.node_id = e.dst
  WHERE o.node_id IS NULL {limit} GROUP BY e.dst)"""


@query("reach_3_hops", hops_sql("SELECT CAST(0 AS BIGINT) AS node_id, CAST(0 AS BIGINT) AS hop, CAST(0 AS BIGINT) AS core", "SELECT src, dst FROM edges", "AND r.hop < 3") + " SELECT node_id, hop FROM h")
def reach_3_hops(spark, sf_dir):
    g = geo_graph(spark, sf_dir)
    return components.reachable(g.edges, g.nodes.where("node_id = 0"), 3)


_CORES = "SELECT * FROM (VALUES (CAST(499 AS BIGINT), CAST(0 AS BIGINT), CAST(499 AS BIGINT)), (3, 0, 3), (250, 0, 250)) v(node_id, hop, core)"


def _cores(spark):
    return spark.createDataFrame([(499, 0), (3, 1), (250, 2)], "node_id long, order int")


@query("hop_bfs", hops_sql(_CORES, "SELECT src, dst FROM edges") + " SELECT node_id, hop, core FROM h")
def hop_bfs(spark, sf_dir):
    return components.hop_bfs(geo_graph(spark, sf_dir).edges, _cores(spark))


@query("hop_bfs_in_cell", hops_sql(_CORES, "SELECT src, dst FROM plevel WHERE diff = 0") + " SELECT node_id, hop, core FROM h")
def hop_bfs_in_cell(spark, sf_dir):
    g = geo_graph(spark, sf_dir)
    return components.hop_bfs(g.edges, _cores(spark), g.nodes.select("node_id", F.col("partition").alias("cell")))


# --- components ------------------------------------------------------------------------------

_NEAR = ", near AS (SELECT src, dst FROM edges WHERE c0 < 350)"
_LABELS = """WITH RECURSIVE {geo}{near}, l(node_id, component) USING KEY (node_id) AS (
  SELECT node_id, node_id AS component FROM nodes
  UNION
  SELECT x.node_id, x.component FROM (SELECT e.dst AS node_id, min(r.component) AS component FROM l r JOIN (SELECT src, dst FROM near UNION SELECT dst, src FROM near) e ON e.src = r.node_id GROUP BY e.dst) x
    JOIN recurring.l o ON o.node_id = x.node_id WHERE x.component < o.component)""".format(geo=GEO, near=_NEAR)


def _near(g: Graph) -> DataFrame:
    return g.edges.where(F.col("cost")[0] < 350)


@query("components", _LABELS + " SELECT node_id, component FROM l")
def components_query(spark, sf_dir):
    g = geo_graph(spark, sf_dir)
    return components.components(g.nodes, _near(g))


_LARGEST = _LABELS + ", best AS (SELECT component FROM l GROUP BY component ORDER BY count(*) DESC, component LIMIT 1), kept AS (SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS k FROM l WHERE component = (SELECT component FROM best))"


@query("largest_component", _LARGEST + " SELECT node_id FROM kept")
def largest_component(spark, sf_dir):
    g = geo_graph(spark, sf_dir)
    return components.largest_component(g.nodes, _near(g))


@query("largest_set", _LARGEST + " SELECT i.k AS src, j.k AS dst FROM near JOIN kept i ON i.node_id = src JOIN kept j ON j.node_id = dst")
def largest_set(spark, sf_dir):
    g = geo_graph(spark, sf_dir)
    return components.largest_set(g.nodes, _near(g))[1].select("src", "dst")


# --- spatial -----------------------------------------------------------------------------------


@query("grid_bounds", with_geo("SELECT min(lat) AS lat_min, max(lat) AS lat_max, min(lng) AS lng_min, max(lng) AS lng_max FROM nodes"))
def grid_bounds(spark, sf_dir):
    return spatial.bounds(geo_graph(spark, sf_dir).nodes)


_GRID = """, b AS (SELECT min(lat) AS la, max(lat) AS lb, min(lng) AS ga, max(lng) AS gb FROM nodes),
g AS (SELECT node_id, lat, lng, CAST(greatest(0, floor((lat - la) / (lb - la) * 135)) AS BIGINT) AS lat_index, CAST(greatest(0, floor((lng - ga) / (gb - ga) * 99)) AS BIGINT) AS lng_index FROM nodes, b),
gc AS (SELECT *, lng_index * 136 + lat_index AS cell FROM g)"""


@query("grid_cells", with_geo("SELECT node_id, lat_index, lng_index, cell FROM gc", _GRID))
def grid_cells(spark, sf_dir):
    n = geo_graph(spark, sf_dir).nodes
    return spatial.grid(n, spatial.grid_bounds(n)).select("node_id", "lat_index", "lng_index", "cell")


@query("cell_counts", with_geo("SELECT cell, count(*) AS n, CAST(coalesce(sum(count(*)) OVER (ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM gc GROUP BY cell", _GRID))
def cell_counts(spark, sf_dir):
    n = geo_graph(spark, sf_dir).nodes
    return spatial.cell_counts(n, spatial.grid_bounds(n))


_HAVERSINE = "2 * 6371.0 * atan2(sqrt({a}), sqrt(1 - {a}))".format(a="(sin(radians({lat2} - {lat1}) / 2) * sin(radians({lat2} - {lat1}) / 2) + cos(radians({lat1})) * cos(radians({lat2})) * sin(radians({lng2} - {lng1}) / 2) * sin(radians({lng2} - {lng1}) / 2))")
_POINTS = ", pt AS (SELECT c_custkey AS point_id, (c_custkey * 7919 % 10007) / 100.07::DOUBLE - 50 AS lat, (c_custkey * 104729 % 10009) / 100.09::DOUBLE - 50 AS lng FROM customer)"


def _points(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select(F.col("c_custkey").alias("point_id"), ((F.col("c_custkey") * 7919 % 10007) / 100.07 - 50).alias("lat"), ((F.col("c_custkey") * 104729 % 10009) / 100.09 - 50).alias("lng"))


@query("edge_lengths_km", with_geo(f"SELECT edge_id, CAST(floor({_HAVERSINE.format(lat1='p.lat', lng1='p.lng', lat2='q.lat', lng2='q.lng')} * 1000) AS BIGINT) AS metres FROM edges JOIN nodes p ON p.node_id = src JOIN nodes q ON q.node_id = dst"))
def edge_lengths_km(spark, sf_dir):
    g = geo_graph(spark, sf_dir)
    n = g.nodes.select("node_id", "lat", "lng")
    e = g.edges.join(n.toDF("src", "a", "b"), "src").join(n.toDF("dst", "c", "d"), "dst")
    return e.select("edge_id", F.floor(haversine_km(F.col("a"), F.col("b"), F.col("c"), F.col("d")) * 1000).alias("metres"))


_PAIR = _HAVERSINE.format(lat1="pt.lat", lng1="pt.lng", lat2="o.lat", lng2="o.lng")


@query("nearest_exact", with_geo(f"SELECT point_id, arg_min(node_id, d) AS node_id, CAST(floor(min(d) * 1000) AS BIGINT) AS metres FROM (SELECT point_id, node_id, {_PAIR} AS d FROM pt, nodes o) GROUP BY point_id", _POINTS))
def nearest_exact(spark, sf_dir):
    return spatial.nearest_exact(_points(spark, sf_dir), geo_graph(spark, sf_dir).nodes).select("point_id", "node_id", F.floor(F.col("distance_km") * 1000).alias("metres"))


@query("nearest_ring", with_geo(f"""SELECT point_id, ring, arg_min(node_id, d) AS node_id FROM (
  SELECT *, min(ring) OVER (PARTITION BY point_id) AS least FROM (SELECT point_id, node_id, greatest(1, abs(lat_index - pi), abs(lng_index - pj)) AS ring, {_PAIR} AS d FROM
    (SELECT pt.*, CAST(greatest(0, floor((lat - la) / (lb - la) * 135)) AS BIGINT) AS pi, CAST(greatest(0, floor((lng - ga) / (gb - ga) * 99)) AS BIGINT) AS pj FROM pt, b) pt, gc o)) WHERE ring = least GROUP BY point_id, ring""", _GRID + _POINTS))
def nearest_ring(spark, sf_dir):
    n = geo_graph(spark, sf_dir).nodes
    return spatial.nearest_ring(_points(spark, sf_dir), n, spatial.grid_bounds(n)).select("point_id", F.col("ring").cast("long").alias("ring"), "node_id")


@query("k_nearest", with_geo("SELECT f, t FROM knn"))
def k_nearest(spark, sf_dir):
    return spatial.k_nearest(points(spark, sf_dir), 4)


# --- partitions -----------------------------------------------------------------------------------


@query("partition_ids", with_geo("SELECT node_id, partition AS p0, partition // 4 AS p1, partition // 16 AS p2 FROM nodes"))
def partition_ids(spark, sf_dir):
    g = geo_graph(spark, sf_dir)
    return g.nodes.select("node_id", all_partition_ids(F.col("partition"), g.mlp_levels).alias("p")).select("node_id", *[F.col("p")[k].alias(f"p{k}") for k in range(3)])


@query("differing_levels", with_geo("SELECT edge_id, CAST(diff AS INTEGER) AS diff FROM plevel"))
def differing_levels(spark, sf_dir):
    g = geo_graph(spark, sf_dir)
    p = g.nodes.select("node_id", "partition")
    return g.edges.join(p.toDF("src", "p1"), "src").join(p.toDF("dst", "p2"), "dst").select("edge_id", differing_level(F.col("p1"), F.col("p2"), g.mlp_levels).alias("diff"))


@query("node_levels", with_geo("SELECT node_id, level FROM nlevel"))
def node_levels(spark, sf_dir):
    return contraction.node_levels(geo_graph(spark, sf_dir))


@query("boundary_nodes", with_geo("SELECT CAST(sum(CAST(level >= 1 AS INTEGER)) AS BIGINT) AS boundary, count(*) AS nodes, 1 - sum(CAST(level >= 1 AS INTEGER)) / count(*)::DOUBLE AS contracted FROM nlevel"))
def boundary_nodes(spark, sf_dir):
    return evaluation.boundary_nodes(contraction.node_levels(geo_graph(spark, sf_dir)))


@query("contracted_share", with_geo("SELECT level, count(*) AS n, sum(count(*)) OVER (ORDER BY level) / (SELECT count(*) FROM nlevel)::DOUBLE AS share FROM nlevel GROUP BY level"))
def contracted_share(spark, sf_dir):
    g = geo_graph(spark, sf_dir)
    return contraction.contracted_share(g.with_(nodes=g.nodes.drop("level").join(contraction.node_levels(g), "node_id")))


@query("partition_sizes", with_geo("SELECT count(*) AS cells, max(c) AS largest, min(c) AS smallest FROM (SELECT count(*) AS c FROM nodes GROUP BY partition)"))
def partition_sizes(spark, sf_dir):
    return partitioners.partition_sizes(geo_graph(spark, sf_dir).nodes)


@query("partition_csv", with_geo("SELECT node_id, lat, lng AS lon, partition AS partition0, partition // 4 AS partition1, level AS highest_diff FROM nodes JOIN nlevel USING (node_id)"))
def partition_csv(spark, sf_dir):
    return io.partition_csv(geo_graph(spark, sf_dir))


_H = ", h AS (SELECT node_id, (SELECT count(*) FROM edges WHERE src = node_id) * (SELECT count(*) FROM edges WHERE dst = node_id) AS h FROM nodes)"


def _heuristic(g: Graph) -> DataFrame:
    return adjacency.degrees(g.nodes, g.edges).select("node_id", (F.col("out_degree") * F.col("in_degree")).alias("h"))


@query("contraction_heuristic", with_geo("SELECT node_id, CASE WHEN level = 0 THEN h ELSE 9223372036854775807 END AS h FROM h JOIN nlevel USING (node_id)", _H))
def contraction_heuristic(spark, sf_dir):
    g = geo_graph(spark, sf_dir)
    return _heuristic(g).join(contraction.node_levels(g), "node_id").select("node_id", F.when(F.col("level") == 0, F.col("h")).otherwise(F.lit((1 << 63) - 1)).alias("h"))


@query("independent_set", with_geo("SELECT node_id FROM h WHERE NOT EXISTS (SELECT 1 FROM edges JOIN h o ON o.node_id = dst WHERE src = h.node_id AND (o.h < h.h OR (o.h = h.h AND o.node_id < h.node_id))) AND NOT EXISTS (SELECT 1 FROM edges JOIN h o ON o.node_id = src WHERE dst = h.node_id AND (o.h < h.h OR (o.h = h.h AND o.node_id < h.node_id)))", _H))
def independent_set(spark, sf_dir):
    g = geo_graph(spark, sf_dir)
    return contraction.independent_set(_heuristic(g), g.edges)


@query("lowest_decile", with_geo("SELECT node_id, h FROM (SELECT *, row_number() OVER (ORDER BY h, node_id) AS r, count(*) OVER () AS c FROM h) WHERE c <= 10 OR r <= ceil(c / 10)", _H))
def lowest_decile(spark, sf_dir):
    return contraction.lowest_decile(_heuristic(geo_graph(spark, sf_dir))).select("node_id", "h")


@query("gonzalez_cells")
def gonzalez_cells(spark, sf_dir):
    g = geo_graph(spark, sf_dir)
    return partitioners.gonzalez(g.nodes, g.edges, [4, 4])[0]


@query("kmeans_cells")
def kmeans_cells(spark, sf_dir):
    return partitioners.kmeans(geo_graph(spark, sf_dir).nodes, [4, 4])[0]


@query("merge_cells")
def merge_cells(spark, sf_dir):
    g = geo_graph(spark, sf_dir)
    return partitioners.merge(g.nodes, g.edges, [30, 120])[0]


@query("batch_prp_by_rounds", BATCH_SQL)
def batch_prp_by_rounds(spark, sf_dir):
    """Answered on an overlay whose levels were contracted in rounds of independent sets."""
    g = geo_graph(spark, sf_dir)
    return paths.solve(contraction.contract(g, cell_edges=0, share=0.7), batch(g), "prp").select("id", "cost")


@query("overlay_edges")
def overlay_edges(spark, sf_dir):
    return overlay(spark, sf_dir).edges.select("edge_id", "src", "dst", "cost", "level", "via")


# --- evaluation ---------------------------------------------------------------------------------------

_FOUND = "found AS (SELECT event_id AS id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS a, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 5 = 0 THEN value + 2 ELSE value + 0.5 END AS b FROM events WHERE value IS NOT NULL)"


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _timings(spark, sf_dir):
    return _events(spark, sf_dir).select(F.col("event_type").alias("method"), (F.col("user_id") % 4).alias("setting"), F.floor(F.col("value") * 1000).cast("long").alias("time"), "event_id")


_T = "t AS (SELECT event_type AS method, user_id % 4 AS setting, CAST(floor(value * 1000) AS BIGINT) AS time, event_id FROM events)"


@query("check_buckets", f"WITH {_FOUND} SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL AND abs(a - b) < 1.0) AS correct_with_path, count(*) FILTER (a IS NULL AND b IS NULL) AS correct_no_path, count(*) FILTER (a IS NOT NULL AND (b IS NULL OR abs(a - b) >= 1.0)) AS incorrect_with_path, count(*) FILTER (a IS NULL AND b IS NOT NULL) AS incorrect_no_path FROM found")
def check_buckets(spark, sf_dir):
    e = _events(spark, sf_dir).where("value is not null")
    a = e.select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("cost"))
    b = e.select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 11 == 0, None).when(F.col("event_id") % 5 == 0, F.col("value") + 2).otherwise(F.col("value") + 0.5).alias("cost"))
    return evaluation.check_buckets(a, b)


@query("method_agreement", "SELECT method, CAST(24 AS BIGINT) AS correct_with_path, CAST(0 AS BIGINT) AS correct_no_path, CAST(0 AS BIGINT) AS incorrect_with_path, CAST(0 AS BIGINT) AS incorrect_no_path FROM (VALUES ('bi'), ('pch'), ('pcrp'), ('prp')) v(method)")
def method_agreement(spark, sf_dir):
    g, out = overlay(spark, sf_dir), None
    q = batch(g)
    reference = cut(paths.solve(g, q))
    for m in paths.METHODS[1:]:
        one = evaluation.check_buckets(paths.solve(g, q, m), reference, 1e-9).withColumn("method", F.lit(m))
        out = one if out is None else out.unionByName(one)
    return out


@query("mean_times", f"WITH {_T} SELECT method, setting, avg(time) / 1000000 AS mean_ms FROM t GROUP BY 1, 2")
def mean_times(spark, sf_dir):
    return evaluation.mean_times(_timings(spark, sf_dir))


@query("speed_ups", f"WITH {_T}, m AS (SELECT method, setting, avg(time) / 1000000 AS ms FROM t GROUP BY 1, 2) SELECT m.method, m.setting, b.ms / m.ms AS speed_up FROM m JOIN m b ON b.setting = m.setting AND b.method = (SELECT min(method) FROM m)")
def speed_ups(spark, sf_dir):
    t = _timings(spark, sf_dir)
    return evaluation.speed_ups(t, t.agg(F.min("method")).first()[0])


@query("time_quantiles", f"WITH {_T} SELECT method, quantile_cont(CAST(time AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(time AS DOUBLE), 0.5) AS median, quantile_cont(CAST(time AS DOUBLE), 0.75) AS q3 FROM t GROUP BY method")
def time_quantiles(spark, sf_dir):
    return evaluation.time_quantiles(_timings(spark, sf_dir))


@query("pivot_first", f"WITH {_T} SELECT setting, count(*) FILTER (method = 'click') AS click, count(*) FILTER (method = 'view') AS view FROM t GROUP BY setting")
def pivot_first(spark, sf_dir):
    counts = _timings(spark, sf_dir).groupBy("setting", "method").agg(F.count("*").alias("n"))
    return evaluation.pivot_first(counts, "setting", "method", "n", ["click", "view"]).na.fill(0)


@query("uneven_groups", f"WITH {_T} SELECT method, setting, count(*) AS n FROM t GROUP BY 1, 2 HAVING count(*) <> 500")
def uneven_groups(spark, sf_dir):
    return evaluation.uneven_groups(_timings(spark, sf_dir), ["method", "setting"], 500)


@query("last_runs", f"WITH {_T} SELECT method, arg_max(time, event_id) AS time FROM t GROUP BY method")
def last_runs(spark, sf_dir):
    return evaluation.last_of(_timings(spark, sf_dir), "method", "event_id", "time")


# --- formats ------------------------------------------------------------------------------------------------


@query("edge_wkt", with_geo("SELECT edge_id || ';LINESTRING(' || p.lng || ' ' || p.lat || ', ' || q.lng || ' ' || q.lat || ')' AS line FROM edges JOIN nodes p ON p.node_id = src JOIN nodes q ON q.node_id = dst"))
def edge_wkt(spark, sf_dir):
    g = geo_graph(spark, sf_dir)
    return io.wkt_edges(g.edges, g.nodes)


@query("path_geojson")
def path_geojson(spark, sf_dir):
    g = geo_graph(spark, sf_dir)
    p = cut(paths.solve(g, batch(g)))
    return io.geojson_feature(p.select("id", "cost"), io.path_coordinates(paths.path_nodes(p, g.edges), g.nodes))


@query("path_geojson_ends", BATCH_SQL.replace("q.id, dist.cost FROM", "q.id, coalesce(printf('%.2f', dist.cost), 'no path found') AS cost, CASE WHEN dist.cost IS NOT NULL AND s <> t THEN a.lng END AS first_lng, CASE WHEN dist.cost IS NOT NULL AND s <> t THEN a.lat END AS first_lat, CASE WHEN dist.cost IS NOT NULL AND s <> t THEN b.lng END AS last_lng, CASE WHEN dist.cost IS NOT NULL AND s <> t THEN b.lat END AS last_lat FROM") + " JOIN nodes a ON a.node_id = q.s JOIN nodes b ON b.node_id = q.t")
def path_geojson_ends(spark, sf_dir):
    """Cost and ends as they stand in the GeoJSON text."""
    r = path_geojson(spark, sf_dir).select("id", F.from_json("feature", "type string, geometry struct<coordinates:array<array<double>>>, properties struct<cost:string>").alias("f"))
    line = F.col("f.geometry.coordinates")
    last = F.get(line, F.size(line) - 1)
    return r.select("id", F.col("f.properties.cost").alias("cost"), F.get(F.get(line, F.lit(0)), F.lit(0)).alias("first_lng"), F.get(F.get(line, F.lit(0)), F.lit(1)).alias("first_lat"), F.get(last, F.lit(0)).alias("last_lng"), F.get(last, F.lit(1)).alias("last_lat"))


@query("snapped_queries")
def snapped_queries(spark, sf_dir):
    g = geo_graph(spark, sf_dir)
    return spatial.snap(io.random_queries(g, 200), g.nodes, spatial.grid_bounds(g.nodes))


@query("fmi_round_trip", with_geo("SELECT edge_id, src, dst, c0, c1, c2 FROM edges"))
def fmi_round_trip(spark, sf_dir):
    import uuid

    from ..session import shared_folder
    from ..sources.fmi import read_fmi, write_fmi

    path = f"{shared_folder(spark)}/fmi-{uuid.uuid4().hex}"
    write_fmi(geo_graph(spark, sf_dir), path)
    return read_fmi(spark, path).edges.select("edge_id", "src", "dst", *[F.col("cost")[i].alias(f"c{i}") for i in range(3)])


@query("request_stream")
def request_stream(spark, sf_dir):
    """Requests between fixed nodes and two bad ones, streamed from files and answered batch by batch."""
    import uuid

    from ..session import shared_folder
    from ..streaming.requests import serve

    g = geo_graph(spark, sf_dir)
    n = g.nodes.select("node_id", "lat", "lng")
    q = batch(g).join(n.toDF("start_id", "a", "b"), "start_id").join(n.toDF("end_id", "c", "d"), "end_id")
    body = F.format_string('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"LineString","coordinates":[[%s,%s],[%s,%s]]},"properties":{"alpha":%s}},{"type":"Feature","geometry":{"type":"LineString","coordinates":[[%s,%s],[%s,%s]]}}]}', *[F.col(c).cast("string") for c in "baba"], F.to_json("alpha"), *[F.col(c).cast("string") for c in "dcdc"])
    rows = q.select("id", body.alias("body")).unionByName(spark.createDataFrame([(900, "{}"), (901, "no json")], "id long, body string"))
    folder = f"{shared_folder(spark)}/requests-{uuid.uuid4().hex}"
    rows.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("id long, body string").option("maxFilesPerTrigger", 4).parquet(f"{folder}/in")
    running = serve(stream, g, spatial.grid_bounds(g.nodes), lambda df, k: df.write.mode("overwrite").parquet(f"{folder}/out/{k}"), f"{folder}/state")
    running.processAllAvailable()
    running.stop()
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/out")
