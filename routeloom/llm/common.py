"""Shared plumbing of the text operators: table access and Arrow batch slicing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text handed to one Python call; bounds the working set of a worker.
SLICE_CHARS = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, text_col: str = "text", limit: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut a record batch where its texts exceed ``limit`` bytes; a single longer text stays whole."""
    n = batch.num_rows
    if n == 0:
        return
    lengths = pc.binary_length(batch.column(text_col)).fill_null(0).to_pylist()
    start, size = 0, 0
    for i, k in enumerate(lengths):
        if size and size + k > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += k
    yield batch.slice(start, n - start)


def release() -> None:
    """Give memory that a task has freed back to the system: workers live on, and an executor's limit counts them all."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def map_text(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, text_col: str = "text", limit: int = SLICE_CHARS, after: Callable[[], None] | None = None
) -> DataFrame:
    """Run ``fn`` on bounded slices of the Arrow batches of ``df``; ``after`` ends each task, since workers live on and their memory counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for piece in slices(batch, text_col, limit):
                    yield fn(piece)
        finally:
            if after is not None:
                after()
            release()

    return df.mapInArrow(run, schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session; one of its own only on a local master without that setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return folder or "/tmp/checkpoints/routeloom"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of this program's own through the file system that Spark writes to."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder, so that lost executors take nothing with them."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id's decimal text, remainder 1 of 3."""
    return (F.crc32(F.col(doc_id).cast("string")) % 3) == 1
