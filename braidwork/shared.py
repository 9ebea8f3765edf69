"""The folder that driver and executors share, and tables written to it.

A cluster names the folder in ``spark.checkpoint.dir``.  Only where that is
unset (local tests) a folder of this machine is chosen.
"""

from __future__ import annotations

import atexit
import ctypes
import hashlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder; set for the session where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        local = f"{tempfile.gettempdir()}/braidwork-{spark.sparkContext.applicationId}"
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        found = f"file://{local}"
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of the shared folder that nobody has used."""
    return f"{shared_dir(spark)}/braidwork/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path through Hadoop's file system, whatever store holds it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Options of a table whose bytes count more than the time to pack them.
PACKED = {"compression": "zstd"}


class Written:
    """A DataFrame written to the shared folder and read back.

    Cuts lineage and survives lost executors: the files belong to the store,
    not to an executor.  options: those of the writer, such as PACKED for bases and names.
    """

    def __init__(self, df: DataFrame, name: str, **options: str):
        self.spark = df.sparkSession
        self.path = fresh_path(self.spark, name)
        df.write.options(**options).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        remove(self.spark, self.path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """One small file of the shared folder, whatever store holds it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(data))
    out.close()


def spool(spark: SparkSession, stream: BinaryIO, path: str, size: int = 1 << 20) -> None:
    """Copy a stream to a file of any store, a piece at a time."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    while piece := stream.read(size):
        out.write(bytearray(piece))
    out.close()


def ship_bytes(spark: SparkSession, data: bytes) -> str:
    """Have every executor fetch a file of these bytes; its name, for SparkFiles.get."""
    name = f"blob-{hashlib.sha256(data).hexdigest()[:32]}"
    if not os.path.exists(SparkFiles.get(name)):
        write_bytes(spark, path := f"{shared_dir(spark)}/braidwork/files/{name}", data)
        spark.sparkContext.addFile(path)
    return name


#: Rows and bytes of a batch that goes to a Python worker, so that long texts don't fill its memory.
BATCH_ROWS, BATCH_BYTES = 2_000, 4 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, with the session's Arrow batches no larger than the bounds above."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(BATCH_ROWS, int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) or BATCH_ROWS)))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def released(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work, a function of a task's batches, that gives freed memory back to the system in the end; an idle worker would keep it beside those of later stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
            if trim:
                trim(0)

    return run
