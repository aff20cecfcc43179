"""Time-frequency representations: five frequency scales by three amplitude scales, as relational plans.

Every result is long: signal_id, frame, bin, value; power is formed once, other amplitudes are projections of it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import require
from ..params import CqtParams, ErbParams, LogHzParams, LogParams, MelParams, SpectroParams
from . import filterbanks as fb
from .fourier import BASIS_LIMIT, frames, power, stft

AMPLITUDES = ("power", "magnitude", "db")


def amplitude(value: Column, scale: str, log: LogParams | None = None) -> Column:
    """Of a power. dB without a floor stays power; power and magnitude take no notice of a floor."""
    require(scale in AMPLITUDES, f"the amplitude must be one of {AMPLITUDES}")
    if scale == "magnitude":
        return F.sqrt(value)
    if scale == "db" and log is not None:
        return F.lit(10.0) * F.log10(F.greatest(value, F.lit(log.least)))
    return value


def _scaled(df: DataFrame, scale: str, log: LogParams | None) -> DataFrame:
    return df.withColumn("value", amplitude(F.col("value"), scale, log))


def linear_power(long: DataFrame, p: SpectroParams, length: int | None = None, first: int = 0, last: int | None = None) -> DataFrame:
    return stft(long, p.stft, length, first, last).select("signal_id", "frame", "bin", power().alias("value"))


def linear(long: DataFrame, p: SpectroParams, scale: str = "power", log: LogParams | None = None, length: int | None = None) -> DataFrame:
    return _scaled(linear_power(long, p, length), scale, log)


def mel(long: DataFrame, p: SpectroParams, m: MelParams, scale: str = "power", log: LogParams | None = None, length: int | None = None) -> DataFrame:
    return _scaled(fb.apply_weights(linear_power(long, p, length), fb.mel_weights(p, m)), scale, log)


def log_hz(long: DataFrame, p: SpectroParams, b: LogHzParams, scale: str = "power", log: LogParams | None = None, length: int | None = None) -> DataFrame:
    return _scaled(fb.apply_weights(linear_power(long, p, length), fb.log_hz_weights(p, b)), scale, log)


def erb(long: DataFrame, p: SpectroParams, e: ErbParams, scale: str = "power", log: LogParams | None = None, length: int | None = None) -> DataFrame:
    return _scaled(fb.apply_weights(linear_power(long, p, length), fb.erb_weights(p, e)), scale, log)


def cqt_bins(framed: DataFrame, sample_rate: float, c: CqtParams, size: int, keys: tuple[str, ...] = ("signal_id", "frame")) -> DataFrame:
    """keys, bin, re, im: correlation of frames (keys, i, v) with the kernels at their right end.

    The kernels' table has size rows a bin at most; above BASIS_LIMIT samples a frame the vectorised plan is to be used."""
    require(size <= BASIS_LIMIT, "frames this long take the vectorised plan")
    matrix = fb.cqt_matrix(sample_rate, c, size)
    band, at = np.nonzero(matrix)
    rows = [(int(b), int(i), float(matrix[b, i].real), float(matrix[b, i].imag)) for b, i in zip(band, at, strict=True)]
    kernel = framed.sparkSession.createDataFrame(rows, "band int, _i long, kr double, ki double")
    parts = framed.join(F.broadcast(kernel), F.col("i") == F.col("_i"))
    return parts.groupBy(*keys, F.col("band").alias("bin")).agg(F.sum(F.col("v") * F.col("kr")).alias("re"), F.sum(F.col("v") * F.col("ki")).alias("im"))


def cqt_complex(long: DataFrame, p: SpectroParams, c: CqtParams, length: int | None = None) -> DataFrame:
    require(c.frequency(c.n_bins - 1) < p.nyquist, "the highest bin must be below the Nyquist frequency")
    return cqt_bins(frames(long, p.stft, False, length), p.sample_rate, c, p.stft.n_fft)


def cqt(long: DataFrame, p: SpectroParams, c: CqtParams, scale: str = "power", log: LogParams | None = None, length: int | None = None) -> DataFrame:
    out = cqt_complex(long, p, c, length).select("signal_id", "frame", "bin", power().alias("value"))
    return _scaled(out, scale, log)


def db_range(spectra: DataFrame, scale: str = "power") -> DataFrame:
    """low, high of the values in dB: 1e-12 is added to powers before the logarithm, dB values are taken as they are."""
    v = F.col("value") if scale == "db" else F.lit(10.0) * F.log10((F.col("value") * F.col("value") if scale == "magnitude" else F.col("value")) + F.lit(1e-12))
    return spectra.agg(F.min(v).alias("low"), F.max(v).alias("high"))


def statistics(spectra: DataFrame) -> DataFrame:
    return spectra.agg(F.count("value").alias("n"), F.min("value").alias("minimum"), F.max("value").alias("maximum"), F.avg("value").alias("mean"))


def with_axes(spectra: DataFrame, p: SpectroParams, frequencies: np.ndarray) -> DataFrame:
    """time_s and freq_hz beside each value; the axis is a table of one row a bin."""
    axis = fb.axis_table(spectra.sparkSession, frequencies).withColumnRenamed("bin", "_b")
    return spectra.join(F.broadcast(axis), F.col("bin") == F.col("_b")).drop("_b").withColumn("time_s", F.col("frame").cast("double") * F.lit(p.period))


def output_shape(lengths: DataFrame, p: SpectroParams, n_bands: int) -> DataFrame:
    """signal_id, n_bands, n_frames from the lengths (signal_id, length) alone."""
    padded = F.col("length") + 2 * p.stft.pad
    count = F.when(padded < p.stft.n_fft, F.lit(1)).otherwise(F.floor((padded - p.stft.n_fft) / p.stft.hop) + 1)
    return lengths.select("signal_id", F.lit(n_bands).alias("n_bands"), count.cast("long").alias("n_frames"))


def duration(spectra: DataFrame, p: SpectroParams) -> DataFrame:
    """Time of the last frame of each signal."""
    return spectra.groupBy("signal_id").agg((F.max("frame").cast("double") * F.lit(p.period)).alias("duration_s"))
