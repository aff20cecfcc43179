"""Framing and one-dimensional Fourier operators as relational plans.

A transform is a join with a small basis table and a grouped sum, so partial sums come before the shuffle and SQL can
say the same. The basis has n_fft (n_fft / 2 + 1) rows; above BASIS_LIMIT the vectorised plans of sonoplan.plans
are the ones to use, and these raise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidInput, require
from ..functions.windows import Window
from ..params import StftParams

#: Most points of a transform whose basis is a broadcast table (8,320 rows at 128).
BASIS_LIMIT = 128


def _turn(a: Column, b: Column, n: int) -> Column:
    """The angle 2 pi a b / n, from the remainder of a b, which keeps it exact."""
    return F.lit(2 * math.pi / n) * F.pmod(a * b, F.lit(n)).cast("double")


def basis(spark: SparkSession, n_fft: int, first: int = 0, last: int | None = None) -> DataFrame:
    """i, k, bc, bs: cosine and sine of the angle of sample i in bin k, for bins first to last."""
    if n_fft > BASIS_LIMIT:
        raise InvalidInput(f"a basis of {n_fft} points is too large for a table; use a vectorised plan")
    last = n_fft // 2 if last is None else last
    n = last - first + 1
    cell = spark.range(n_fft * n).select((F.col("id") / n).cast("long").alias("i"), (F.col("id") % n + first).cast("int").alias("k"))
    return cell.select("i", "k", F.cos(_turn(F.col("i"), F.col("k"), n_fft)).alias("bc"), F.sin(_turn(F.col("i"), F.col("k"), n_fft)).alias("bs"))


def frames(long: DataFrame, p: StftParams, windowed: bool = True, length: Column | int | None = None, key: str = "signal_id") -> DataFrame:
    """key, frame, i, v of every sample in every frame that holds it; samples outside the signal are zero and have no row.

    A sample goes to its frames by arithmetic alone, so a signal of any length is framed without being gathered.
    length: samples of the signals, if they are all as long; else it is found by a sum over each signal."""
    if length is None:
        sizes = long.groupBy(F.col(key).alias("_k")).agg((F.max("n") + 1).alias("_len"))
        long = long.join(sizes, F.col(key) == F.col("_k")).drop("_k")
    else:
        long = long.withColumn("_len", (length if isinstance(length, Column) else F.lit(length)).cast("long"))
    at = F.col("n") + F.lit(p.pad)
    count = F.when(F.col("_len") + 2 * p.pad < p.n_fft, F.lit(1).cast("long")).otherwise(F.floor((F.col("_len") + (2 * p.pad - p.n_fft)) / p.hop) + 1)
    first = F.greatest(F.lit(0).cast("long"), F.floor((at - p.n_fft + p.hop) / p.hop))
    last = F.least(F.floor(at / p.hop), count - 1)
    spread = long.where(first <= last).select(key, F.explode(F.sequence(first, last)).alias("frame"), at.alias("_at"), "x")
    i = F.col("_at") - F.col("frame") * p.hop
    v = F.col("x") * p.window.column(i, p.n_fft) if windowed else F.col("x")
    return spread.select(key, F.col("frame").cast("int").alias("frame"), i.cast("long").alias("i"), v.alias("v"))


def whole_frame(long: DataFrame, n_fft: int, window: Window | None = None, key: str = "signal_id") -> DataFrame:
    """Each signal as one frame of n_fft samples, zeros on the right; a longer signal is an error."""
    checked = F.when(F.col("n") < n_fft, F.col("n")).otherwise(F.raise_error(F.lit("a signal is longer than n_fft")).cast("long"))
    v = F.col("x") if window is None else F.col("x") * window.column(F.col("n"), n_fft)
    return long.select(key, F.lit(0).alias("frame"), checked.alias("i"), v.alias("v"))


def transform(framed: DataFrame, n_fft: int, first: int = 0, last: int | None = None, keys: tuple[str, ...] = ("signal_id", "frame")) -> DataFrame:
    """keys, bin, re, im of frames (keys, i, v): unnormalised, e^(-j 2 pi k i / n), bins 0 to n_fft / 2 or a part of them."""
    b = basis(framed.sparkSession, n_fft, first, last).withColumnRenamed("i", "_i")
    # The basis has BASIS_LIMIT (BASIS_LIMIT / 2 + 1) rows at most.
    parts = framed.join(F.broadcast(b), F.col("i") == F.col("_i"))
    return parts.groupBy(*keys, F.col("k").alias("bin")).agg(F.sum(F.col("v") * F.col("bc")).alias("re"), (-F.sum(F.col("v") * F.col("bs"))).alias("im"))


def power(re: str = "re", im: str = "im") -> Column:
    return F.col(re) * F.col(re) + F.col(im) * F.col(im)


def fft(long: DataFrame, n_fft: int) -> DataFrame:
    return transform(whole_frame(long, n_fft), n_fft).drop("frame")


def rfft(long: DataFrame, n_fft: int) -> DataFrame:
    """Magnitudes, not complex bins."""
    return fft(long, n_fft).select("signal_id", "bin", F.sqrt(power()).alias("value"))


def power_spectrum(long: DataFrame, n_fft: int, window: Window | None = None) -> DataFrame:
    """The window spans all n_fft points, of which the signal fills the first."""
    return transform(whole_frame(long, n_fft, window), n_fft).select("signal_id", "bin", power().alias("value"))


def magnitude_spectrum(long: DataFrame, n_fft: int, window: Window | None = None) -> DataFrame:
    return power_spectrum(long, n_fft, window).withColumn("value", F.sqrt("value"))


def inverse(spectrum: DataFrame, n_fft: int, keys: tuple[str, ...] = ("signal_id",)) -> DataFrame:
    """keys, i, y: the n_fft real samples of half spectra (keys, bin, re, im), divided by n_fft."""
    b = basis(spectrum.sparkSession, n_fft)
    twice = F.when((F.col("k") == 0) | (F.lit(n_fft % 2 == 0) & (F.col("k") == n_fft // 2)), 1.0).otherwise(2.0)
    parts = spectrum.join(F.broadcast(b), F.col("bin") == F.col("k"))
    return parts.groupBy(*keys, "i").agg((F.sum(twice * (F.col("re") * F.col("bc") - F.col("im") * F.col("bs"))) / F.lit(float(n_fft))).alias("y"))


def irfft(spectrum: DataFrame, n_fft: int) -> DataFrame:
    """signal_id, n, x; a half spectrum has n_fft / 2 + 1 bins exactly."""
    checked = spectrum.withColumn("bin", F.when(F.col("bin").between(0, n_fft // 2), F.col("bin")).otherwise(F.raise_error(F.lit("a spectrum has bins beyond n_fft / 2")).cast("int")))
    return inverse(checked, n_fft).select("signal_id", F.col("i").alias("n"), F.col("y").alias("x"))


def stft(long: DataFrame, p: StftParams, length: int | None = None, first: int = 0, last: int | None = None, key: str = "signal_id") -> DataFrame:
    """key, frame, bin, re, im."""
    return transform(frames(long, p, length=length, key=key), p.n_fft, first, last, (key, "frame"))


#: Sums of squared windows up to this are not divided by.
LEAST_WEIGHT = 1e-10


def istft(spectra: DataFrame, p: StftParams) -> DataFrame:
    """signal_id, n, x: windowed inverse frames, added where they overlap, over the sum of squared windows; centring is cut off."""
    require(p.hop <= p.n_fft, "hop must not exceed n_fft")
    w = p.window.column(F.col("i"), p.n_fft)
    parts = inverse(spectra, p.n_fft, ("signal_id", "frame")).select("signal_id", (F.col("frame") * p.hop + F.col("i")).alias("at"), "frame", (F.col("y") * w).alias("y"), (w * w).alias("ww"))
    ends = spectra.groupBy(F.col("signal_id").alias("_k")).agg((F.max("frame") * p.hop + p.n_fft).alias("_end"))
    added = parts.groupBy("signal_id", "at").agg(F.sum("y").alias("y"), F.sum("ww").alias("ww"))
    x = F.when(F.col("ww") > LEAST_WEIGHT, F.col("y") / F.col("ww")).otherwise(F.col("y"))
    inside = (F.col("at") >= p.pad) & (F.col("at") < F.col("_end") - p.pad)
    return added.join(ends, F.col("signal_id") == F.col("_k")).where(inside).select("signal_id", (F.col("at") - p.pad).cast("long").alias("n"), x.alias("x"))


def fft_frequencies(spark: SparkSession, n: int, d: float = 1.0) -> DataFrame:
    """i, value: 0, 1, ... then the negative ones, over n d."""
    i = F.col("id")
    return spark.range(n).select(i.cast("int").alias("i"), (F.when(i < (n + 1) // 2, i).otherwise(i - n).cast("double") / F.lit(n * d)).alias("value"))


def rfft_frequencies(spark: SparkSession, n: int, d: float = 1.0) -> DataFrame:
    return spark.range(n // 2 + 1).select(F.col("id").cast("int").alias("i"), (F.col("id").cast("double") / F.lit(n * d)).alias("value"))


def shift(position: Column, n: Column | int, inverse_: bool = False) -> Column:
    """Where a position goes when the axis rotates left by half: by floor(n / 2), or by its complement."""
    n = n if isinstance(n, Column) else F.lit(n)
    half = F.floor(n / 2)
    return F.pmod(position - (n - half if inverse_ else half), n)


def fftshift_1d(long: DataFrame, n: int, inverse_: bool = False) -> DataFrame:
    return long.withColumn("n", shift(F.col("n"), n, inverse_).cast("long"))
