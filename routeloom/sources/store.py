"""The prepared graph as a folder of Parquet tables: nodes, edges (clustered by src), grid, meta."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators.spatial import grid, grid_bounds


def write_graph(g: Graph, path: str, partitions: int = 64) -> None:
    spark, b = g.nodes.sparkSession, grid_bounds(g.nodes)
    g.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    # levels together within a file: overlay searches then skip row groups by their statistics
    g.edges.repartition(partitions, "src").sortWithinPartitions(F.col("level").desc_nulls_last(), "src").write.mode("overwrite").parquet(f"{path}/edges")
    grid(g.nodes, b).select("cell", "node_id").write.mode("overwrite").parquet(f"{path}/grid")
    meta = spark.createDataFrame([(list(g.mlp_levels), list(g.metrics), g.dim, [b.lat_min, b.lat_max, b.lng_min, b.lng_max])], "mlp_levels array<long>, metrics array<string>, dim int, bounds array<double>")
    meta.write.mode("overwrite").parquet(f"{path}/meta")


def read_graph(spark: SparkSession, path: str) -> Graph:
    meta = spark.read.parquet(f"{path}/meta").first()
    return Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"), meta["dim"], tuple(meta["metrics"]), tuple(meta["mlp_levels"]))


def metrics(g: Graph) -> DataFrame:
    """metrics: what the metrics endpoint answers, as JSON."""
    spark = g.edges.sparkSession
    return spark.createDataFrame([(list(g.metrics),)], "m array<string>").select(F.to_json("m").alias("metrics"))
