"""Query files, generated workloads, and the formats that results are written in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import Graph
from ..session import numbered

POSITION = "struct<latitude:double,longitude:double>"
QUERY = f"id long, orig_start_id long, orig_end_id long, start_id long, end_id long, start_pos {POSITION}, end_pos {POSITION}, alpha array<double>"


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """Query objects of an evaluation file: one array, or one object a line."""
    first = spark.read.text(path).where("trim(value) <> ''").first()
    return spark.read.schema(QUERY).json(path, multiLine=bool(first) and first[0].lstrip().startswith("["))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_json_array(df: DataFrame, path: str) -> None:
    """One file with one array of objects, for readers that take no lines of JSON; its writer is one task."""
    rows = df.select(F.to_json(F.struct(*df.columns)).alias("value"))
    one = rows.agg(F.concat(F.lit("["), F.concat_ws(",\n", F.sort_array(F.collect_list("value"))), F.lit("]")).alias("value"))
    one.write.mode("overwrite").text(path)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Result files by their ending: CSV with a header, or JSON as one array or one object a line."""
    if path.rstrip("/").endswith(".csv"):
        return spark.read.schema(schema).csv(path, header=True, sep=";")
    first = spark.read.text(path).where("trim(value) <> ''").first()
    return spark.read.schema(schema).json(path, multiLine=bool(first) and first[0].lstrip().startswith("["))


def sweep_between(g: Graph, start: tuple[float, float], end: tuple[float, float], steps: int) -> DataFrame:
    """A query for each preference of ``alpha_sweep`` between the nodes nearest to two positions (lat, lng)."""
    from ..operators.spatial import nearest_exact

    spark = g.nodes.sparkSession
    at = spark.createDataFrame([("orig_start_id", *map(float, start)), ("orig_end_id", *map(float, end))], "point_id string, lat double, lng double")
    ends = nearest_exact(at, g.nodes).groupBy(F.lit(0).alias("one")).pivot("point_id", ["orig_start_id", "orig_end_id"]).agg(F.first("node_id")).drop("one")
    place = g.nodes.select("node_id", F.struct(F.col("lat").alias("latitude"), F.col("lng").alias("longitude")).alias("pos"))
    ends = ends.join(place.toDF("orig_start_id", "start_pos"), "orig_start_id").join(place.toDF("orig_end_id", "end_pos"), "orig_end_id")
    sweep = numbered(alpha_sweep(spark, g.dim, steps), ["alpha"], "id")
    none = F.lit(None).cast("long")
    return sweep.join(F.broadcast(ends)).select("id", "orig_start_id", "orig_end_id", none.alias("start_id"), none.alias("end_id"), "start_pos", "end_pos", "alpha")  # one row


def path_pairs(path_nodes: DataFrame) -> DataFrame:
    """id, pos, src, dst of consecutive nodes of (id, nodes)."""
    each = path_nodes.select("id", F.posexplode("nodes").alias("pos", "src"))
    return each.withColumn("dst", F.lead("src").over(Window.partitionBy("id").orderBy("pos"))).where("dst is not null")


def random_queries(g: Graph, n: int, seed: int = 1) -> DataFrame:
    """``n`` uniform pairs of nodes with preferences uniform on the simplex; the same for the same seed."""
    spark = g.nodes.sparkSession
    ids = numbered(g.nodes.select("node_id", "lat", "lng"), ["node_id"], "k")
    total = ids.count()
    u = lambda *salt: (F.pmod(F.xxhash64("id", F.lit(seed), *map(F.lit, salt)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    gamma = F.array(*[-F.log(u("alpha", i)) for i in range(g.dim)])
    base = spark.range(n).select("id", F.floor(u("s") * total).alias("ks"), F.floor(u("t") * total).alias("kt"), gamma.alias("e"))
    start = ids.select(F.col("k").alias("ks"), F.col("node_id").alias("orig_start_id"), F.struct(F.col("lat").alias("latitude"), F.col("lng").alias("longitude")).alias("start_pos"))
    end = ids.select(F.col("k").alias("kt"), F.col("node_id").alias("orig_end_id"), F.struct(F.col("lat").alias("latitude"), F.col("lng").alias("longitude")).alias("end_pos"))
    total_e = F.aggregate("e", F.lit(0.0), lambda a, b: a + b)
    out = base.join(start, "ks").join(end, "kt").select("id", "orig_start_id", "orig_end_id", "start_pos", "end_pos", F.transform("e", lambda x: x / total_e).alias("alpha"))
    return out.select("id", "orig_start_id", "orig_end_id", F.lit(None).cast("long").alias("start_id"), F.lit(None).cast("long").alias("end_id"), "start_pos", "end_pos", "alpha")


def alpha_sweep(spark: SparkSession, dim: int, steps: int) -> DataFrame:
    """alpha: all vectors with parts k / steps that sum to one.  Each further part is drawn from what the parts before have left, so no vector is made in vain."""
    out = spark.range(1).select(F.array().cast("array<long>").alias("a"), F.lit(steps).cast("long").alias("left"))
    for _ in range(dim - 1):
        out = out.select("a", "left", F.explode(F.sequence(F.lit(0).cast("long"), F.col("left"))).alias("k")).select(F.concat("a", F.array("k")).alias("a"), (F.col("left") - F.col("k")).alias("left"))
    return out.select(F.transform(F.concat("a", F.array("left")), lambda x: x / F.lit(float(steps))).alias("alpha"))


def geojson_feature(paths: DataFrame, coordinates: DataFrame) -> DataFrame:
    """id and a GeoJSON feature (line of [lng, lat]); no path gives no coordinates and says so.

    paths: id, cost.  coordinates: id, pos, lat, lng.
    """
    line = coordinates.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "lng", "lat"))).alias("s")).select("id", F.transform("s", lambda x: F.array(x["lng"], x["lat"])).alias("line"))
    cost = F.when(F.col("cost").isNull(), "no path found").otherwise(F.format_string("%.2f", F.col("cost")))
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("LineString").alias("type"), F.coalesce("line", F.array().cast("array<array<double>>")).alias("coordinates")).alias("geometry"),
        F.struct(cost.alias("cost")).alias("properties"),
    )
    return paths.join(line, "id", "left").select("id", F.to_json(feature).alias("feature"))


def path_coordinates(path_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, pos, node_id, lat, lng of (id, nodes)."""
    return path_nodes.select("id", F.posexplode("nodes").alias("pos", "node_id")).join(nodes.select("node_id", "lat", "lng"), "node_id").select("id", "pos", "node_id", "lat", "lng")


def wkt_points(points: DataFrame) -> DataFrame:
    """node_id; kind; wkt of (node_id, lat, lng, kind): kind 0 marks an end, 1 a meeting node."""
    return points.select(F.concat_ws(";", F.col("node_id").cast("string"), F.col("kind").cast("string"), F.concat(F.lit("POINT("), F.col("lng").cast("string"), F.lit(" "), F.col("lat").cast("string"), F.lit(")"))).alias("line"))


def wkt_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    n = nodes.select("node_id", "lat", "lng")
    e = edges.join(n.toDF("src", "lat1", "lng1"), "src").join(n.toDF("dst", "lat2", "lng2"), "dst")
    text = F.concat(F.lit("LINESTRING("), F.concat_ws(", ", F.concat_ws(" ", F.col("lng1").cast("string"), F.col("lat1").cast("string")), F.concat_ws(" ", F.col("lng2").cast("string"), F.col("lat2").cast("string"))), F.lit(")"))
    return e.select(F.concat_ws(";", F.col("edge_id").cast("string"), text).alias("line"))


def path_csv(coordinates: DataFrame) -> DataFrame:
    return coordinates.select("id", "pos", F.concat_ws(";", F.col("pos").cast("string"), F.col("node_id").cast("string"), F.col("lat").cast("string"), F.col("lng").cast("string")).alias("line"))


def export_query(prefix: str, points: DataFrame, visited: DataFrame, coordinates: DataFrame, edges: DataFrame, nodes: DataFrame) -> None:
    """The four files of one traced query."""
    for name, df in (("query.wkt", wkt_points(points)), ("nodes.wkt", wkt_points(visited)), ("path.csv", path_csv(coordinates).orderBy("id", "pos").select("line")), ("edges.wkt", wkt_edges(edges, nodes))):
        df.write.mode("overwrite").text(f"{prefix}-{name}")


def write_partition_csv(g: Graph, path: str) -> None:
    """``partition_csv`` as files with a header, without the node's id, as the analysis reads them."""
    partition_csv(g).drop("node_id").write.mode("overwrite").csv(path, header=True)


def partition_csv(g: Graph) -> DataFrame:
    """lat, lon, the cell at each level and the highest level at which a neighbour's cell differs."""
    from ..functions import partition_id
    from ..operators.contraction import node_levels

    levels: Sequence[int] = g.mlp_levels
    return g.nodes.drop("level").join(node_levels(g), "node_id").select("node_id", "lat", F.col("lng").alias("lon"), *[partition_id(F.col("partition"), k, levels).alias(f"partition{k}") for k in range(len(levels))], F.col("level").alias("highest_diff"))
