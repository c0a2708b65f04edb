"""Helpers shared by the corpus operators: shared-folder checkpoints and Arrow batching."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``; where that is unset,
    a temporary folder of this machine, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share")
        base = "file://" + tempfile.mkdtemp(prefix="locusframe-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def cut(df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back.

    A lost executor then costs a reread, never a recomputation of the plan above.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lf-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._path = path
    return out


def release() -> None:
    """Hand freed memory back to the system, so that a worker that waits for its next task holds little."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library keeps it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def released(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``fn`` over a partition's batches, then ``release``."""

    def run(batches):
        yield from fn(batches)
        release()

    return run


def tidy(spark: SparkSession, *done: DataFrame) -> None:
    """Free disk: delete cut tables that no later step reads, and let Spark drop the
    shuffle files of finished jobs, which it does when their plans are collected."""
    jvm = spark.sparkContext._jvm
    for df in done:
        path = jvm.org.apache.hadoop.fs.Path(df._path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    release()
    jvm.System.gc()


def in_parts(df: DataFrame, files: int = 32) -> Iterator[Row]:
    """The rows of a table whose size is bounded, a partition at a time, so that the driver
    never holds them all; they are written first, so a lost executor costs a reread.

    ``files`` deals them out, as rows that compress well would else be one partition."""
    held = cut(df.repartition(files))
    yield from held.toLocalIterator()
    tidy(df.sparkSession, held)


def packed_bits(bits: np.ndarray) -> bytes:
    """A part of a bitmap, compressed: at small inputs it's nearly empty."""
    return zlib.compress(np.packbits(bits).tobytes(), 1)


def unpacked_bits(blob: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob), np.uint8)


def small_batches(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches sent to Python by bytes, so that long texts don't pile up.

    Every operator sets it, so that none depends on what ran before it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 20))
    # plans are told to listeners as text, literals in full
    spark.conf.set("spark.sql.maxPlanStringLength", "100000")
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/documents.parquet")


def utf8(text: Column) -> Column:
    """UTF-8 bytes of a text, null as empty."""
    return F.coalesce(text.cast("binary"), F.lit(b""))


def gathered(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.Table]:
    """Regroup Arrow batches into tables whose ``column`` holds about ``limit`` bytes.

    A single longer value still makes a table of its own; nothing is cut.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        at = 0
        col = batch.column(batch.schema.get_field_index(column))
        import pyarrow.compute as pc

        ends = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        done = 0
        while at < batch.num_rows:
            room = limit - size
            stop = int(np.searchsorted(ends, done + room, side="right"))
            stop = max(stop, at + (0 if held else 1))
            if stop > at:
                held.append(batch.slice(at, stop - at))
                size += int(ends[stop - 1]) - done
                done = int(ends[stop - 1])
            if stop < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            at = stop
    if held:
        yield pa.Table.from_batches(held)
