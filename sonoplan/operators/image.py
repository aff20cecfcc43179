"""Two-dimensional transforms and filters as relational plans: long images (image_id, r, c, v), all of one shape.

A transform is two grouped sums, rows first, then columns: R C (R + C) products, not (R C)^2. Spectra are half along
columns: C / 2 + 1 of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import require
from .fourier import BASIS_LIMIT, shift


def _basis(spark: SparkSession, n: int, m: int, a: str, b: str) -> DataFrame:
    """a, b, bc, bs for a below n and b below m: the angle 2 pi a b / n."""
    require(n <= BASIS_LIMIT, f"images of more than {BASIS_LIMIT} rows or columns take plans.spatial.ImagePlan")
    cell = spark.range(n * m).select((F.col("id") / m).cast("int").alias(a), (F.col("id") % m).cast("int").alias(b))
    turn = F.lit(2 * math.pi / n) * F.pmod(F.col(a) * F.col(b), F.lit(n)).cast("double")
    return cell.select(a, b, F.cos(turn).alias("bc"), F.sin(turn).alias("bs"))


def fft2d(image: DataFrame, rows: int, cols: int) -> DataFrame:
    """image_id, r, c, re, im: unnormalised; r below rows, c up to cols / 2."""
    spark = image.sparkSession
    across = _basis(spark, cols, cols // 2 + 1, "_c", "kc")
    one = image.join(F.broadcast(across), F.col("c") == F.col("_c")).groupBy("image_id", "r", "kc").agg(F.sum(F.col("v") * F.col("bc")).alias("re"), (-F.sum(F.col("v") * F.col("bs"))).alias("im"))
    down = _basis(spark, rows, rows, "_r", "kr")
    two = one.join(F.broadcast(down), F.col("r") == F.col("_r")).groupBy("image_id", "kr", "kc")
    # (re + j im)(cos - j sin)
    out = two.agg(F.sum(F.col("re") * F.col("bc") + F.col("im") * F.col("bs")).alias("re"), F.sum(F.col("im") * F.col("bc") - F.col("re") * F.col("bs")).alias("im"))
    return out.select("image_id", F.col("kr").alias("r"), F.col("kc").alias("c"), "re", "im")


def ifft2d(spectrum: DataFrame, rows: int, cols: int) -> DataFrame:
    """image_id, r, c, v; the imaginary parts of the first and, if cols is even, the last column count as 0 after the column inverse."""
    spark = spectrum.sparkSession
    down = _basis(spark, rows, rows, "_r", "y")
    one = spectrum.join(F.broadcast(down), F.col("r") == F.col("_r")).groupBy("image_id", "y", "c").agg(
        F.sum(F.col("re") * F.col("bc") - F.col("im") * F.col("bs")).alias("re"), F.sum(F.col("im") * F.col("bc") + F.col("re") * F.col("bs")).alias("im")
    )
    edge = (F.col("c") == 0) | (F.lit(cols % 2 == 0) & (F.col("c") == cols // 2))
    across = _basis(spark, cols, cols, "x", "_c")
    part = F.when(edge, F.col("re") * F.col("bc")).otherwise(2 * (F.col("re") * F.col("bc") - F.col("im") * F.col("bs")))
    out = one.join(F.broadcast(across.where(F.col("_c") <= cols // 2)), F.col("c") == F.col("_c")).groupBy("image_id", F.col("y").alias("r"), "x").agg((F.sum(part) / F.lit(float(rows * cols))).alias("v"))
    return out.select("image_id", "r", F.col("x").alias("c"), "v")


def power_2d(image: DataFrame, rows: int, cols: int) -> DataFrame:
    return fft2d(image, rows, cols).select("image_id", "r", "c", (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("v"))


def magnitude_2d(image: DataFrame, rows: int, cols: int) -> DataFrame:
    return power_2d(image, rows, cols).withColumn("v", F.sqrt("v"))


def shift_2d(image: DataFrame, rows: int, cols: int, inverse: bool = False) -> DataFrame:
    """Both axes rotated left by half (floor), or back (by the rest)."""
    return image.withColumn("r", shift(F.col("r"), rows, inverse).cast("int")).withColumn("c", shift(F.col("c"), cols, inverse).cast("int"))


def gaussian_kernel(spark: SparkSession, size: int, sigma: float) -> DataFrame:
    """r, c, w: weights that sum to 1."""
    require(size > 0 and size % 2 == 1, "the kernel's size must be odd")
    require(sigma > 0, "sigma must be positive")
    cell = spark.range(size * size).select((F.col("id") / size).cast("int").alias("r"), (F.col("id") % size).cast("int").alias("c"))
    raw = cell.withColumn("e", F.exp(-((F.col("r") - size // 2) * (F.col("r") - size // 2) + (F.col("c") - size // 2) * (F.col("c") - size // 2)) / F.lit(2.0 * sigma * sigma)))
    total = raw.agg(F.sum("e").alias("t"))
    return raw.join(F.broadcast(total)).select("r", "c", (F.col("e") / F.col("t")).alias("w"))  # one row


#: Most weights of a kernel that goes along with each pixel.
KERNEL_LIMIT = 4096


def convolve(image: DataFrame, kernel: DataFrame, rows: int, cols: int, kernel_rows: int, kernel_cols: int) -> DataFrame:
    """Circular convolution, the kernel's middle (half, rounded down) at the pixel: each pixel is spread over the kernel's places and summed."""
    require(kernel_rows <= rows and kernel_cols <= cols, "the kernel must not exceed the image")
    require(kernel_rows * kernel_cols <= KERNEL_LIMIT, "a kernel this large takes plans.spatial.ImagePlan")
    k = kernel.select((F.col("r") - kernel_rows // 2).alias("dr"), (F.col("c") - kernel_cols // 2).alias("dc"), "w")
    spread = image.join(F.broadcast(k))  # KERNEL_LIMIT rows at most; every pixel has use for each
    return spread.groupBy("image_id", F.pmod(F.col("r") + F.col("dr"), F.lit(rows)).cast("int").alias("r"), F.pmod(F.col("c") + F.col("dc"), F.lit(cols)).cast("int").alias("c")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def lowpass_mask(r: Column, c: Column, rows: int, cols: int, cutoff: float) -> Column:
    """1 within cutoff of the smaller half axis, else 0. The mask is laid out on the half spectrum and both indexes wrap, so columns beyond half of it count as low."""
    half = cols // 2 + 1
    dr = F.least(r, F.lit(rows) - r)
    dc = F.least(c, F.lit(half) - c)
    radius = min(rows // 2, half // 2) * cutoff
    return F.when(dr * dr + dc * dc <= F.lit(radius * radius), 1.0).otherwise(0.0)


def _filtered(image: DataFrame, rows: int, cols: int, mask: Column) -> DataFrame:
    spectrum = fft2d(image, rows, cols).withColumn("_m", mask)
    return ifft2d(spectrum.select("image_id", "r", "c", (F.col("re") * F.col("_m")).alias("re"), (F.col("im") * F.col("_m")).alias("im")), rows, cols)


def _share(x: float, what: str) -> None:
    require(0 <= x <= 1, f"{what} must be from 0 to 1")


def lowpass(image: DataFrame, rows: int, cols: int, cutoff: float) -> DataFrame:
    _share(cutoff, "the cut-off")
    return _filtered(image, rows, cols, lowpass_mask(F.col("r"), F.col("c"), rows, cols, cutoff))


def highpass(image: DataFrame, rows: int, cols: int, cutoff: float) -> DataFrame:
    _share(cutoff, "the cut-off")
    return _filtered(image, rows, cols, 1 - lowpass_mask(F.col("r"), F.col("c"), rows, cols, cutoff))


def bandpass(image: DataFrame, rows: int, cols: int, low: float, high: float) -> DataFrame:
    _share(low, "the lower cut-off")
    _share(high, "the upper cut-off")
    require(low < high, "the lower cut-off must be below the upper one")
    r, c = F.col("r"), F.col("c")
    return _filtered(image, rows, cols, lowpass_mask(r, c, rows, cols, high) - lowpass_mask(r, c, rows, cols, low))


def edges(image: DataFrame, rows: int, cols: int) -> DataFrame:
    return highpass(image, rows, cols, 0.1)


def sharpen(image: DataFrame, rows: int, cols: int, amount: float) -> DataFrame:
    require(amount >= 0, "the amount must not be negative")
    detail = highpass(image, rows, cols, 0.2).withColumnRenamed("v", "_d")
    return image.join(detail, ["image_id", "r", "c"]).select("image_id", "r", "c", (F.col("v") + F.lit(float(amount)) * F.col("_d")).alias("v"))
