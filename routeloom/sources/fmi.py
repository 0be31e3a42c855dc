"""FMI graph text: comment header, one separator line, dimension, node and edge counts, nodes, edges.

Nodes: ``id osm_id lat lng height 0``; edges: ``src dst c1 .. cd e1 e2``.  A node's id is its
position.  Lines are numbered by partition counts, so a file of any size is read in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph, edge_table, node_table
from ..session import cut, numbered


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line, value in the order of file names and lines: the text source keeps order within a split, and splits are ordered by their start."""
    lines = cut(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("k")))
    return numbered(lines, ["file", "block", "k"], "line").select("line", "value")


def read_fmi(spark: SparkSession, path: str, tolerant: bool = False) -> Graph:
    """The graph of an FMI file; contraction ids other than -1 become ``via``.  ``tolerant`` skips blank and comment lines wherever they stand."""
    lines = numbered_lines(spark, path)
    if tolerant:
        metrics = lines.where("trim(value) rlike '^#\\\\s*metrics:'").orderBy("line").limit(1)
        plain = numbered(lines.where("trim(value) <> '' and not startswith(ltrim(value), '#')").drop("__l").withColumnRenamed("line", "was"), ["was"], "line")
        # read on as a strict file: the comment with the metrics, the separator, the rest
        first = [(0, r["value"].strip()) for r in metrics.collect()]
        head = spark.createDataFrame([*first, (len(first), "")], "line long, value string")
        lines = head.unionByName(plain.select((F.col("line") + len(first) + 1).alias("line"), "value"))
    lines = cut(lines)
    header = lines.where(F.col("line") < 1000).orderBy("line").limit(1000).collect()  # the header; its comments are few
    k, metrics = 0, ()
    while header[k]["value"].startswith("#"):
        text = header[k]["value"].lstrip("#").strip()
        if text.startswith("metrics:"):
            metrics = tuple(x.strip() for x in text[8:].split(",") if x.strip())
        k += 1
    k += 1  # the separator
    dim, n, m = (int(header[k + i]["value"]) for i in range(3))
    first = header[k]["line"] + 3
    fields = lines.where(F.col("line") >= first).select((F.col("line") - first).alias("at"), F.split(F.trim("value"), r"\s+").alias("f"))
    nodes = fields.where(F.col("at") < n).select(F.col("at").alias("node_id"), F.col("f")[1].cast("long").alias("osm_id"), F.col("f")[2].cast("double").alias("lat"), F.col("f")[3].cast("double").alias("lng"), F.col("f")[2].alias("lat_raw"), F.col("f")[3].alias("lng_raw"), F.col("f")[4].alias("height_raw"))
    edges = fields.where((F.col("at") >= n) & (F.col("at") < n + m)).select((F.col("at") - n).alias("edge_id"), F.col("f")[0].cast("long").alias("src"), F.col("f")[1].cast("long").alias("dst"), F.array(*[F.col("f")[2 + i].cast("double") for i in range(dim)]).alias("cost"), *[F.get("f", F.lit(2 + dim + i)).cast("long").alias(n) for i, n in enumerate(("first", "second"))])
    edges = edges.withColumn("via", F.when((F.col("first") >= 0) & (F.col("second") >= 0), F.struct("first", "second"))).drop("first", "second")
    extra = fields.where((F.col("at") >= n + m) & (F.size("f") > 0) & (F.col("f")[0] != "")).limit(1).count()
    if extra:
        raise ValueError("data after the last edge")
    full = node_table(nodes).join(nodes.select("node_id", "osm_id", "lat_raw", "lng_raw", "height_raw"), "node_id")
    return Graph(full, edge_table(edges), dim, metrics)


def write_fmi(g: Graph, path: str) -> None:
    """One text file with nodes and edges in the order of their ids; raw columns, where there are any, are written as they were read."""
    spark, c = g.edges.sparkSession, g.nodes.columns
    text = lambda name, raw: F.col(raw) if raw in c else F.col(name).cast("string")
    osm = F.col("osm_id").cast("string") if "osm_id" in c else F.col("node_id").cast("string")
    height = F.col("height_raw") if "height_raw" in c else F.lit("0")
    head = [f"# metrics: {', '.join(g.metrics)}", "", str(g.dim), str(g.nodes.count()), str(g.edges.count())]
    rows = spark.createDataFrame([(0, i, x) for i, x in enumerate(head)], "part int, k long, value string")
    nodes = g.nodes.select(F.lit(1).alias("part"), F.col("node_id").alias("k"), F.concat_ws(" ", F.col("node_id").cast("string"), osm, text("lat", "lat_raw"), text("lng", "lng_raw"), height, F.lit("0")).alias("value"))
    first, second = (F.coalesce(F.col("via").getField(x).cast("string"), F.lit("-1")) for x in ("first", "second"))
    edges = g.edges.select(F.lit(2).alias("part"), F.col("edge_id").alias("k"), F.concat_ws(" ", F.col("src").cast("string"), F.col("dst").cast("string"), F.transform("cost", lambda x: x.cast("string")), first, second).alias("value"))
    # the format is one ordered file, so its writer is one task
    rows.unionByName(nodes).unionByName(edges).repartition(1).sortWithinPartitions("part", "k").select("value").write.mode("overwrite").text(path)


def read_mlp(spark: SparkSession, path: str) -> tuple[DataFrame, tuple[int, ...]]:
    """node_id, partition and the branching factors, bottom up."""
    lines = cut(numbered_lines(spark, path))
    k = int(lines.where("line = 0").first()["value"])
    factors = tuple(int(r["value"]) for r in lines.where((F.col("line") >= 1) & (F.col("line") <= k)).orderBy("line").collect())
    n = int(lines.where(F.col("line") == k + 1).first()["value"])
    out = lines.where((F.col("line") > k + 1) & (F.col("line") <= k + 1 + n)).select((F.col("line") - (k + 2)).alias("node_id"), F.trim("value").cast("long").alias("partition"))
    total = 1
    for f in factors:
        total *= f
    if out.where((F.col("partition") >= total) | (F.col("partition") < 0)).limit(1).count():
        raise ValueError(f"a partition id is not below {total}")
    return out, factors


def write_mlp(partitions: DataFrame, factors: tuple[int, ...], path: str) -> None:
    spark = partitions.sparkSession
    head = [str(len(factors)), *map(str, factors), str(partitions.count())]
    rows = spark.createDataFrame([(0, i, x) for i, x in enumerate(head)], "part int, k long, value string")
    body = partitions.select(F.lit(1).alias("part"), F.col("node_id").alias("k"), F.col("partition").cast("string").alias("value"))
    rows.unionByName(body).repartition(1).sortWithinPartitions("part", "k").select("value").write.mode("overwrite").text(path)


def with_partitions(g: Graph, partitions: DataFrame | None, factors: tuple[int, ...] = (1,)) -> Graph:
    """The graph with partition ids attached by node; nodes without one, or all without a file, are in cell 0."""
    nodes = g.nodes.drop("partition")
    if partitions is None:
        return g.with_(nodes=nodes.withColumn("partition", F.lit(0).cast("long")), mlp_levels=(1,))
    return g.with_(nodes=nodes.join(partitions.select("node_id", "partition"), "node_id", "left").withColumn("partition", F.coalesce("partition", F.lit(0).cast("long"))), mlp_levels=tuple(factors))
