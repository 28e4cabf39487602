"""Helpers shared by the operators of this subpackage: shared-folder tables, Arrow text views, seeded hashes."""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session, whose one machine holds driver
    and executors, has one of our own where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is to name a folder that the driver and all executors share")
    return path or "/tmp/strandline-shared"


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage is cut and lost executors cost nothing."""
    spark, path = df.sparkSession, new_path(df.sparkSession, kind)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def drop_written(spark: SparkSession, df_or_path) -> None:
    """Remove a table made by written(), or the one at a path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(df_or_path if isinstance(df_or_path, str) else df_or_path.written_to)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: What a Python worker drops at the end of a task: workers live on, and so would what a task has cached.
AT_END: list[Callable[[], None]] = []


def give_back() -> None:
    """Gives what a worker no longer needs back to the system."""
    for drop in AT_END:
        drop()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not this C library
        pass


def tidy(run):
    """run, the generator of a task, with give_back() at its end."""

    @functools.wraps(run)
    def wrapped(*given):
        try:
            yield from run(*given)
        finally:
            give_back()

    return wrapped


def string_array(col) -> pa.Array:
    """A column of a batch as one contiguous string array, nulls as empty texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.type != pa.string():
        col = col.cast(pa.string())
    return col.fill_null("") if col.null_count else col


def views(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array without nulls; offsets count from the first byte."""
    n = len(arr)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(arr.buffers()[1], np.int32)[arr.offset : arr.offset + n + 1].astype(np.int64)
    data = arr.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def from_views(raw: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(off) - 1, pa.py_buffer(np.ascontiguousarray(off, np.int32)), pa.py_buffer(raw))


def pieces(batch: pa.RecordBatch, column: str, most_bytes: int = 8 << 20):
    """Slices of a batch whose texts come to most_bytes at most, or a single longer text."""
    off = views(string_array(batch.column(column)))[1]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most_bytes, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def with_text(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, str]:
    """The columns `keep`, and the text as a string under the name returned: its own, or a new one that clashes with none."""
    if "text" in keep and dict(docs.dtypes)["text"] == "string":
        return docs.select(*keep), "text"
    name = unused("text", keep)
    return docs.select(*keep, F.col("text").cast("string").alias(name)), name


def unused(name: str, among: list[str]) -> str:
    while name.lower() in {c.lower() for c in among}:
        name = f"_{name}"
    return name


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over unsigned integers, wrapping."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def remainder(column: str, n: int) -> Column:
    """crc32 of the id written in decimal, modulo n; null ids count as empty."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n
