"""Modified discrete cosine transform and its inverse, as relational plans."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import require
from ..params import MdctParams
from .fourier import BASIS_LIMIT


def _basis(spark: SparkSession, n: int) -> DataFrame:
    """i below 2n, k below n, b: cos(pi (2i + 1 + n)(2k + 1) / 4n)."""
    require(2 * n <= 2 * BASIS_LIMIT, "windows this long take the vectorised plan")
    cell = spark.range(2 * n * n).select((F.col("id") / n).cast("long").alias("_i"), (F.col("id") % n).cast("int").alias("_k"))
    turn = F.pmod((2 * F.col("_i") + 1 + n) * (2 * F.col("_k") + 1), F.lit(8 * n)).cast("double")
    return cell.select("_i", "_k", F.cos(F.lit(math.pi / (4 * n)) * turn).alias("b"))


def mdct(long: DataFrame, p: MdctParams, length: int | None = None) -> DataFrame:
    """signal_id, frame, k, value: whole frames only, without padding; a shorter signal is an error."""
    n, size = p.n, p.window_size
    if length is None:
        sizes = long.groupBy(F.col("signal_id").alias("_k2")).agg((F.max("n") + 1).alias("_len"))
        long = long.join(sizes, F.col("signal_id") == F.col("_k2")).drop("_k2")
    else:
        long = long.withColumn("_len", F.lit(length).cast("long"))
    count = F.when(F.col("_len") >= size, F.floor((F.col("_len") - size) / p.hop) + 1).otherwise(F.raise_error(F.lit("a signal is shorter than the window")).cast("long"))
    first = F.greatest(F.lit(0).cast("long"), F.floor((F.col("n") - size + p.hop) / p.hop))
    last = F.least(F.floor(F.col("n") / p.hop), count - 1)
    spread = long.where(first <= last).select("signal_id", F.explode(F.sequence(first, last)).alias("frame"), "n", "x")
    i = F.col("n") - F.col("frame") * p.hop
    framed = spread.select("signal_id", F.col("frame").cast("int").alias("frame"), i.alias("i"), (F.col("x") * p.window.column(i, size)).alias("v"))
    parts = framed.join(F.broadcast(_basis(long.sparkSession, n)), F.col("i") == F.col("_i"))
    return parts.groupBy("signal_id", "frame", F.col("_k").alias("k")).agg(F.sum(F.col("v") * F.col("b")).alias("value"))


def imdct(coefficients: DataFrame, p: MdctParams, original_length: int | None = None) -> DataFrame:
    """signal_id, n, x: windowed inverse frames over n / 2, added where they overlap; original_length cuts the end off."""
    n = p.n
    checked = coefficients.withColumn("k", F.when(F.col("k").between(0, n - 1), F.col("k")).otherwise(F.raise_error(F.lit("a frame has more coefficients than half a window")).cast("int")))
    parts = checked.join(F.broadcast(_basis(coefficients.sparkSession, n)), F.col("k") == F.col("_k"))
    w = p.window.column(F.col("_i"), p.window_size)
    at = (F.col("frame") * p.hop + F.col("_i")).cast("long")
    out = parts.groupBy("signal_id", at.alias("n")).agg(F.sum(F.lit(2.0 / n) * w * F.col("value") * F.col("b")).alias("x"))
    return out if original_length is None else out.where(F.col("n") < original_length)
