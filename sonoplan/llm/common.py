"""Helpers that the operators of this subpackage share: tables, the shared folder, Arrow text buffers."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: log2 of the bits of a bitmap (2 MB): a fixed size, whatever the number of rows.
BITMAP = 24
#: A key is hot if it has this part of all rows or more; so there are no more hot keys than this.
HOT = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir; where none is set, a new one, in local mode only."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="sonoplan-shared-")
        sc.setCheckpointDir(f"file://{found}")
        found = f"file://{found}"
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage and outlives any executor."""
    spark = df.sparkSession
    path = new_path(spark, label)
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._stash_path = path
    return out


def discard(*stashed: DataFrame) -> None:
    """Delete stashed tables that no later step reads, and let Spark remove the shuffle files of finished steps."""
    for df in stashed:
        path = getattr(df, "_stash_path", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle files of earlier steps now, not at its half-hourly collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(name: str, columns: list[str]) -> str:
    """The name of a new column: name, with "_found" behind it as often as columns have it already."""
    while name.lower() in map(str.lower, columns):
        name += "_found"
    return name


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Plans made inside hand at most so many rows at a time to Python: long texts then take little memory at once."""
    keys = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"
    before = [spark.conf.get(k) for k in keys]
    for k, b in zip(keys, before, strict=True):
        spark.conf.set(k, str(min(rows, int(b) if int(b) > 0 else rows)))
    try:
        yield
    finally:
        for k, b in zip(keys, before, strict=True):
            spark.conf.set(k, b)


def bitmap(rows: DataFrame, position: Column, width: int = BITMAP) -> bytes:
    """A bitmap of 2^width bits, some of whose positions rows have; it is put together by parts of 4 KB."""
    parts = rows.select(position.cast("long").alias("p")).groupBy(F.shiftright("p", 15).alias("k")).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(32767)).alias("bits")).collect()
    out = bytearray(1 << (width - 3))
    for r in parts:
        out[r.k * 4096 : r.k * 4096 + len(r.bits)] = r.bits
    return bytes(out)


def has_bit(bits: np.ndarray, position: np.ndarray) -> np.ndarray:
    return (bits[position >> 3] >> (position & 7).astype(np.uint8)) & 1 == 1


def position_of(*columns: Column) -> Column:
    """The place of a key in a bitmap."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 64 - BITMAP)


def meet_hot(left: DataFrame, key: Column, salt: Column, right: DataFrame, total: int) -> DataFrame:
    """Left join of left with right (_key string, unique; _value; _n: rows of left that have the key): left's columns and _value.

    Hot keys, HOT of them at most, come from a broadcast table; their rows then go to a task by salt, so no task gets more
    of one key than a HOT-th of all rows."""
    hot = right.where(F.col("_n") * HOT >= total).select(F.col("_key").alias("_hot_key"), F.struct("_value").alias("_hot"))
    met = left.withColumn("_own", key).join(F.broadcast(hot), F.col("_own") == F.col("_hot_key"), "left")
    met = met.withColumn("_own", F.when(F.col("_hot").isNull() & F.col("_own").isNotNull(), F.col("_own")).otherwise(F.concat(F.lit("\0"), salt.cast("string"))))
    cold = right.select("_key", "_value")
    whole = met.join(cold, F.col("_own") == F.col("_key"), "left")
    return whole.select(*left.columns, F.when(F.col("_hot").isNotNull(), F.col("_hot._value")).otherwise(F.col("_value")).alias("_value"))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its values; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, starts


def slices(starts: np.ndarray, most_bytes: int = 2 << 20):
    """(first, last + 1) of runs of values that hold most_bytes together, or one longer value."""
    n, i = len(starts) - 1, 0
    while i < n:
        j = int(np.searchsorted(starts, starts[i] + most_bytes, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j
