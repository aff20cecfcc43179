"""One-dimensional convolution, deconvolution and block filtering as relational plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import require
from .fourier import fft, irfft

#: Most taps of a response that goes along with each sample.
TAPS_LIMIT = 4096


def convolve(long: DataFrame, response: DataFrame, n_taps: int) -> DataFrame:
    """signal_id, n, x: full linear convolution with a response (tap, h), of length + n_taps - 1 samples.

    Each sample is spread over the taps and summed by position; the response has TAPS_LIMIT rows at most."""
    require(0 < n_taps <= TAPS_LIMIT, "a response this long takes the vectorised plan")
    parts = long.join(F.broadcast(response.where(F.col("tap") < n_taps)))
    return parts.groupBy("signal_id", (F.col("n") + F.col("tap")).alias("n")).agg(F.sum(F.col("x") * F.col("h")).alias("x"))


def filter_blocks(long: DataFrame, response: DataFrame, n_taps: int) -> DataFrame:
    """The convolution cut to the signal's own length: what a block-by-block overlap-save filter gives."""
    ends = long.groupBy(F.col("signal_id").alias("_k")).agg(F.max("n").alias("_last"))
    return convolve(long, response, n_taps).join(ends, F.col("signal_id") == F.col("_k")).where("n <= _last").select("signal_id", "n", "x")


def deconvolve(numerator: DataFrame, denominator: DataFrame, n_len: int, d_len: int, regularization: float) -> DataFrame:
    """signal_id, n, x: spectral quotient N conj(D) / (|D|^2 + regularization max |D|^2), circular at the next power of two.

    numerator and denominator are long tables of one key; the quotient has n_len - d_len + 1 samples, or n_len if that is shorter than d_len."""
    n_fft = 1 << (max(n_len, d_len) - 1).bit_length()
    top, low = fft(numerator, n_fft), fft(denominator, n_fft).select(F.col("signal_id").alias("_k"), F.col("bin").alias("_b"), F.col("re").alias("dr"), F.col("im").alias("di"))
    low = low.withColumn("d2", F.col("dr") * F.col("dr") + F.col("di") * F.col("di")).withColumn("m", F.max("d2").over(Window.partitionBy("_k")))
    both = top.join(low, (F.col("signal_id") == F.col("_k")) & (F.col("bin") == F.col("_b"))).withColumn("q", F.col("d2") + F.lit(float(regularization)) * F.col("m"))
    over = lambda x: F.when(F.col("q") == 0, F.lit(0.0)).otherwise(F.try_divide(x, F.col("q")))
    quotient = both.select("signal_id", "bin", over(F.col("re") * F.col("dr") + F.col("im") * F.col("di")).alias("re"), over(F.col("im") * F.col("dr") - F.col("re") * F.col("di")).alias("im"))
    length = n_len - d_len + 1 if n_len >= d_len else n_len
    return irfft(quotient, n_fft).where(F.col("n") < max(1, length))
