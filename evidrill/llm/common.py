"""Shared pieces of the training-data operators: shared storage and Arrow plumbing."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder and runs in one process, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"


#: Bytes of a batch that goes to Python, at most, but for a single row.
BATCH = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    now = re.fullmatch(r"(\d+)b?", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"))
    if now and int(now[1]) > BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return named or LOCAL_CHECKPOINTS


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage is cut and an executor loss costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/evidrill/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*stored: DataFrame) -> None:
    """Deletes tables made by ``materialize`` that nothing will read any more."""
    for df in stored:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow``; what a task has freed goes back to the system, as workers live on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            trim()

    return df.mapInArrow(run, schema)


def trim() -> None:
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that would clash with an operator's own output names."""
    return df.drop(*[c for c in df.columns if c in names])
