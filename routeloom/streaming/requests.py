"""Route requests as a stream of GeoJSON texts.

A request is a collection of two features, each a line of two [lng, lat] positions: the
first position of the first feature is the start, of the second the end.  The preference is
the ``alpha`` of the first feature that has properties; a null or a wrong number of parts is
an error.  Each micro-batch is parsed, snapped to nodes and solved as one batch of queries;
errors come out as rows with status 400, so one bad request spoils no other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import GridBounds
from ..graph import Graph
from ..operators.paths import path_nodes, solve
from ..operators.spatial import snap
from ..sources.queries import POSITION, geojson_feature, path_coordinates

FEATURE = "struct<type:string,geometry:struct<type:string,coordinates:array<array<double>>>,properties:struct<alpha:array<double>>>"
REQUEST = f"struct<type:string,features:array<{FEATURE}>>"


def parse(requests: DataFrame, dim: int) -> DataFrame:
    """id, start_pos, end_pos, alpha, error of (id, body)."""
    r = requests.select("id", F.from_json("body", REQUEST).alias("r"))
    f = F.col("r.features")
    first, second = F.get(f, F.lit(0)), F.get(f, F.lit(1))
    alpha = F.when(first["properties"].isNotNull(), first["properties"]["alpha"]).otherwise(second["properties"]["alpha"])
    shaped = (F.size(f) == 2) & (F.size(first["geometry"]["coordinates"]) == 2) & (F.size(second["geometry"]["coordinates"]) == 2)
    at = lambda x: F.struct(F.get(F.get(x["geometry"]["coordinates"], F.lit(0)), F.lit(1)).alias("latitude"), F.get(F.get(x["geometry"]["coordinates"], F.lit(0)), F.lit(0)).alias("longitude")).cast(POSITION)
    error = (
        F.when(F.col("r").isNull() | ~F.coalesce(shaped, F.lit(False)), "two features of two positions are needed")
        .when(alpha.isNull(), "no preference given")
        .when(F.size(alpha) != dim, f"the preference must have {dim} parts")
    )
    return r.select("id", at(first).alias("start_pos"), at(second).alias("end_pos"), alpha.alias("alpha"), error.alias("error"))


def answer(requests: DataFrame, g: Graph, b: GridBounds, method: str = "normal") -> DataFrame:
    """id, status, body for a batch of (id, body)."""
    parsed = parse(requests, g.dim)
    good = parsed.where("error is null").select("id", F.lit(None).cast("long").alias("start_id"), F.lit(None).cast("long").alias("end_id"), "start_pos", "end_pos", "alpha")
    solved = solve(g, snap(good, g.nodes, b), method)
    line = path_coordinates(path_nodes(solved.where("path is not null"), g.originals()), g.nodes)
    done = geojson_feature(solved.select("id", "cost"), line).select("id", F.lit(200).alias("status"), F.col("feature").alias("body"))
    bad = parsed.where("error is not null").select("id", F.lit(400).alias("status"), F.to_json(F.struct("error")).alias("body"))
    return done.unionByName(bad)


def serve(stream: DataFrame, g: Graph, b: GridBounds, sink: Callable[[DataFrame, int], None], checkpoint: str, method: str = "normal") -> StreamingQuery:
    """Answer a stream of (id, body); ``sink`` gets each batch of answers and its number, and may get a batch again after a failure."""
    return stream.writeStream.foreachBatch(lambda batch, n: sink(answer(batch, g, b, method), n)).option("checkpointLocation", checkpoint).start()
