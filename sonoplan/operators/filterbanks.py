"""Filterbanks: arrays of weights (bands, bins), and the small tables (band, bin, w) that spectra are joined with.

Weights are formed in double precision from parameters alone. A table has as many rows as weights that are not 0.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import require
from ..params import ChromaParams, CqtParams, ErbParams, LogHzParams, MelParams, SpectroParams

#: Weights up to this are left out, before any normalisation.
LEAST = 1e-10
#: Fixed values of the mel scale: Hz a mel below the break, the break, and the logarithmic step above it.
MEL_STEP, MEL_BREAK, MEL_LOG = 200.0 / 3.0, 1000.0, math.log(6.4) / 27.0
#: Fixed values of equivalent rectangular bandwidths.
ERB_BASE, ERB_SLOPE, EAR_Q = 24.7, 4.37, 9.26449


def hz_to_mel(hz):
    hz = np.asarray(hz, dtype=float)
    return np.where(hz < MEL_BREAK, hz / MEL_STEP, MEL_BREAK / MEL_STEP + np.log(np.maximum(hz, MEL_BREAK) / MEL_BREAK) / MEL_LOG)


def mel_to_hz(mel):
    mel = np.asarray(mel, dtype=float)
    edge = MEL_BREAK / MEL_STEP
    return np.where(mel < edge, mel * MEL_STEP, MEL_BREAK * np.exp(MEL_LOG * (np.maximum(mel, edge) - edge)))


def bin_frequencies(p: SpectroParams) -> np.ndarray:
    return np.arange(p.stft.n_bins) * (p.sample_rate / p.stft.n_fft)


def _sparse(weights: np.ndarray) -> np.ndarray:
    return np.where(np.abs(weights) > LEAST, weights, 0.0)


def mel_weights(p: SpectroParams, m: MelParams) -> np.ndarray:
    require(m.f_max <= p.nyquist, "f_max must not exceed the Nyquist frequency")
    points = mel_to_hz(np.linspace(hz_to_mel(m.f_min), hz_to_mel(m.f_max), m.n_mels + 2))
    left, centre, right = (points[k : k + m.n_mels, None] for k in range(3))
    f = bin_frequencies(p)[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        w = np.clip(np.minimum((f - left) / (centre - left), (right - f) / (right - centre)), 0, 1)
    w = _sparse(np.where((centre == left) | (right == centre), 0.0, w))
    if m.norm == "slaney":
        return w * (2 / (right - left))
    if m.norm in ("l1", "l2"):
        size = w.sum(axis=1, keepdims=True) if m.norm == "l1" else np.sqrt((w * w).sum(axis=1, keepdims=True))
        return np.divide(w, size, out=w.copy(), where=size > 0)
    return w


def mel_axis(p: SpectroParams, m: MelParams, own_range: bool = False) -> np.ndarray:
    """Centres over the whole range from 0 to Nyquist, whatever f_min and f_max are; own_range gives the bands' own."""
    low, high = (m.f_min, m.f_max) if own_range else (0.0, p.nyquist)
    return mel_to_hz(np.linspace(hz_to_mel(low), hz_to_mel(high), m.n_mels + 2))[1:-1]


def log_hz_axis(b: LogHzParams) -> np.ndarray:
    return np.exp(np.linspace(math.log(b.f_min), math.log(b.f_max), b.n_bins))


def log_hz_weights(p: SpectroParams, b: LogHzParams) -> np.ndarray:
    """Linear interpolation between the two bins around each frequency."""
    require(b.f_max <= p.nyquist, "f_max must not exceed the Nyquist frequency")
    exact = log_hz_axis(b) / p.resolution
    top = p.stft.n_bins - 1
    low = np.floor(exact).astype(int)
    high = np.minimum(np.ceil(exact).astype(int), top)
    part = exact - low
    out = np.zeros((b.n_bins, p.stft.n_bins))
    for band in np.flatnonzero(low <= top):
        if low[band] == high[band]:
            out[band, low[band]] = 1.0
        else:
            out[band, low[band]], out[band, high[band]] = 1 - part[band], part[band]
    return _sparse(out)


def erb_axis(e: ErbParams) -> np.ndarray:
    """Linear: even steps of bandwidth, which are even steps of Hz. apple_tr35: even steps of ERB rate, low to high."""
    if e.spacing == "linear":
        return np.linspace(e.f_min, e.f_max, e.n_filters)
    shift = EAR_Q * ERB_BASE
    step = (math.log(e.f_min + shift) - math.log(e.f_max + shift)) / e.n_filters
    return np.exp(np.arange(e.n_filters, 0, -1) * step) * (e.f_max + shift) - shift


def erb_weights(p: SpectroParams, e: ErbParams) -> np.ndarray:
    """Power response of a gammatone filter of order four at each bin; dense and not normalised."""
    fc = erb_axis(e)[:, None]
    b = 1.019 * ERB_BASE * (ERB_SLOPE * fc / 1000 + 1)
    return 1 / (1 + ((bin_frequencies(p)[None, :] - fc) / b) ** 2) ** 4


def chroma_weights(p: SpectroParams, c: ChromaParams) -> np.ndarray:
    """A bell of one semitone around each pitch class, on the circle of twelve; rows sum to 1."""
    f = bin_frequencies(p)
    live = (f >= c.f_min) & (f <= c.f_max) & (f > 0)
    pitch = np.mod(69 + 12 * np.log(np.where(live, f, 1.0) / c.tuning) / math.log(2), 12)
    away = np.abs(pitch[None, :] - np.arange(12)[:, None])
    w = np.where(live[None, :], np.exp(-0.5 * np.minimum(away, 12 - away) ** 2), 0.0)
    total = w.sum(axis=1, keepdims=True)
    return np.divide(w, total, out=w, where=total > 0)


def cqt_kernels(sample_rate: float, c: CqtParams, longest: int) -> list[np.ndarray]:
    """Complex kernels of the bins below Nyquist: windowed tones of q periods, longest at most."""
    out = []
    for k in range(c.n_bins):
        f = c.frequency(k)
        if f >= sample_rate / 2:
            break
        n = min(max(1, math.floor(c.q * sample_rate / f + 0.5)), longest)
        if n == 1 and c.window.kind in ("hanning", "hamming", "blackman"):
            w = np.full(1, np.nan)
        else:
            w = c.window.values(n)
        kernel = w * np.exp(2j * np.pi * f * np.arange(n) / sample_rate)
        size = np.abs(kernel)
        if c.sparsity > 0:
            kernel = np.where(size < c.sparsity * np.nanmax(size, initial=0.0), 0, kernel)
        energy = (np.abs(kernel) ** 2).sum()
        out.append(kernel / math.sqrt(energy) if c.normalize and energy > 0 else kernel)
    return out


def cqt_matrix(sample_rate: float, c: CqtParams, size: int) -> np.ndarray:
    """Conjugate kernels as rows over a frame of so many samples, at its right end."""
    kernels = cqt_kernels(sample_rate, c, size)
    out = np.zeros((len(kernels), size), complex)
    for row, k in zip(out, kernels, strict=True):
        row[size - len(k) :] = np.conj(k)
    return out


def dct_weights(n_coefficients: int, n: int) -> np.ndarray:
    """Unnormalised DCT-II."""
    require(n_coefficients <= n, "there are no more coefficients than bands")
    return np.cos(np.pi * np.arange(n_coefficients)[:, None] * (np.arange(n)[None, :] + 0.5) / n)


def weight_table(spark: SparkSession, weights: np.ndarray) -> DataFrame:
    """band, bin, w of the weights that are not 0."""
    band, bins = np.nonzero(weights)
    rows = list(zip(band.tolist(), bins.tolist(), weights[band, bins].tolist(), strict=True))
    return spark.createDataFrame(rows, "band int, bin int, w double")


def axis_table(spark: SparkSession, frequencies: np.ndarray) -> DataFrame:
    """bin, freq_hz."""
    return spark.createDataFrame([(k, float(f)) for k, f in enumerate(frequencies)], "bin int, freq_hz double")


def apply_weights(spectra: DataFrame, weights: np.ndarray, value: str = "value", keys: tuple[str, ...] = ("signal_id", "frame")) -> DataFrame:
    """keys, bin (the band), value: weighted sums over bins. A band without any weight is 0.

    The table is no larger than the filterbank, whose size the parameters bound (10,000 bands of BASIS_LIMIT / 2 + 1 bins)."""
    spark = spectra.sparkSession
    table = weight_table(spark, weights).withColumnRenamed("bin", "_bin")
    empty = [int(k) for k in np.flatnonzero(~weights.any(axis=1))]
    out = spectra.join(F.broadcast(table), F.col("bin") == F.col("_bin")).groupBy(*keys, "band").agg(F.sum(F.col("w") * F.col(value)).alias("value")).select(*keys, F.col("band").alias("bin"), "value")
    if empty:
        silent = spectra.select(*keys).distinct().select(*keys, F.explode(F.array(*map(F.lit, empty))).alias("bin"), F.lit(0.0).alias("value"))
        out = out.unionByName(silent)
    return out
