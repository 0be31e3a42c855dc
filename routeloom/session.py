"""Lineage cuts and dense numbering that hold on a cluster."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, which driver and executors share; a folder of its own only on a local master without that setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return folder or "/tmp/checkpoints/routeloom"


def cut(df: DataFrame) -> DataFrame:
    """Materialise as a Parquet table in the shared folder: loops keep short plans and survive lost executors.

    A table is chosen over a checkpoint because its size is known.  A checkpoint carries the
    estimate of the plan it cuts, and in a loop of joins those estimates multiply round by
    round until planning itself takes longest.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/routeloom-tables/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession) -> None:
    """Remove the tables that ``cut`` has written for this application; what reads from them can't be used any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/routeloom-tables/{spark.sparkContext.applicationId}")
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def is_empty(df: DataFrame) -> bool:
    return df.limit(1).count() == 0


def numbered(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """``df`` with the columns of ``order`` ranked 0, 1, ... in column ``name``, without a window over one partition.

    Rows are range-partitioned and cut first, so that partition numbers stay what they are;
    each partition then adds the count of those before it.
    """
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()))
    sizes = placed.groupBy("__p").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = sizes.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__p").orderBy(*order)
    out = placed.join(F.broadcast(offsets), "__p")
    return out.withColumn(name, (F.col("__before") + F.row_number().over(within) - 1).cast("long")).drop("__p", "__before")
