"""Vectorised plans: one Arrow function over packed signals does framing, transform, bands and amplitude in NumPy.

No shuffle: a signal's row gives its result's row, so a plan is a projection that Spark prunes and filters around. Rows of
a batch are framed together in blocks of bounded size. 32-bit samples stay 32-bit throughout.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DimensionMismatch, InvalidInput, require
from ..operators import filterbanks as fb
from ..params import CqtParams, ErbParams, LogParams, MdctParams, SpectroParams, StftParams

#: Samples of frames that are in memory at once.
BLOCK = 1 << 21


def signals(column: pa.Array) -> list[np.ndarray]:
    """Views of a list column's values; an empty or null signal is an error."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.values.to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy()
    if column.null_count or (np.diff(offsets) <= 0).any():
        raise InvalidInput("a signal is empty")
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def framed(x: np.ndarray, p: StftParams, windowed: bool = True, first: int = 0, last: int | None = None) -> np.ndarray:
    """Frames (first to last) of a signal as rows; beyond its ends it is zero."""
    n = p.frame_count(len(x))
    last = n - 1 if last is None else last
    start = first * p.hop - p.pad
    out = np.zeros((last - first) * p.hop + p.n_fft, x.dtype)
    a, b = max(0, start), min(len(x), start + len(out))
    if b > a:
        out[a - start : b - start] = x[a:b]
    rows = np.lib.stride_tricks.sliding_window_view(out, p.n_fft)[:: p.hop]
    return rows * p.window.values(p.n_fft).astype(x.dtype) if windowed else rows


def power(rows: np.ndarray) -> np.ndarray:
    z = np.fft.rfft(rows, axis=1)
    return z.real**2 + z.imag**2


@dataclass(frozen=True)
class SpectroPlan:
    """A time-frequency transform of packed signals, ready to be applied to any table.

    bands: weights (bands, bins), conjugate CQT kernels (bins, samples), or None for linear bins."""

    params: SpectroParams
    bands: np.ndarray | None = None
    frequencies: np.ndarray | None = None
    kernels: bool = False
    scale: str = "power"
    log: LogParams | None = None

    @property
    def n_bands(self) -> int:
        return self.params.stft.n_bins if self.bands is None else self.bands.shape[0]

    def matrix(self, x: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
        """(frames, bands) of one signal."""
        p = self.params.stft
        last = p.frame_count(len(x)) - 1 if last is None else last
        step, out = max(1, BLOCK // p.n_fft), []
        for k in range(first, last + 1, step):
            rows = framed(x, p, not self.kernels, k, min(last, k + step - 1))
            if self.kernels:
                z = rows @ self.bands.T.astype(np.complex64 if x.dtype == np.float32 else complex)
                values = z.real**2 + z.imag**2
            else:
                values = power(rows)
                if self.bands is not None:
                    values = values @ self.bands.T.astype(x.dtype)
            out.append(values)
        whole = np.concatenate(out)
        if self.scale == "magnitude":
            return np.sqrt(whole)
        if self.scale == "db" and self.log is not None:
            return 10 * np.log10(np.maximum(whole, np.asarray(self.log.least, whole.dtype)))
        return whole

    def column(self, samples: Column, dtype: str = "double", frame: int | None = None) -> Column:
        """array of frames, each an array of bands; or that of one frame, of zeros if it is past the end."""
        kind = pa.float32() if dtype == "float" else pa.float64()
        own, np_kind = self, np.float32 if dtype == "float" else np.float64

        @F.arrow_udf(f"array<array<{dtype}>>")
        def compute(column: pa.Array) -> pa.Array:
            found = [own.matrix(x.astype(np_kind, copy=False), frame or 0, frame) for x in signals(column)]
            counts = np.array([len(m) for m in found])
            flat = np.concatenate([m.ravel() for m in found]).astype(np_kind, copy=False)
            inner = pa.ListArray.from_arrays(pa.array(np.arange(counts.sum() + 1) * own.n_bands, pa.int32()), pa.array(flat, kind))
            return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), inner)

        return compute(samples)

    def compute(self, packed: DataFrame, dtype: str = "double", key: str = "signal_id", samples: str = "samples") -> DataFrame:
        """key, frames (array of arrays of bands)."""
        return packed.select(F.col(key), self.column(F.col(samples), dtype).alias("frames"))

    def compute_frame(self, packed: DataFrame, frame: int, key: str = "signal_id", samples: str = "samples") -> DataFrame:
        """key, bands of one frame; only that frame is formed."""
        return packed.select(F.col(key), F.element_at(self.column(F.col(samples), frame=frame), 1).alias("bands"))

    def long(self, packed: DataFrame, key: str = "signal_id") -> DataFrame:
        """key, frame, bin, value: the same rows as the relational plan gives."""
        each = self.compute(packed, key=key).select(key, F.posexplode("frames").alias("frame", "bands"))
        return each.select(key, "frame", F.posexplode("bands").alias("bin", "value"))

    def output_shape(self, n_samples: int) -> tuple[int, int]:
        return self.n_bands, self.params.stft.frame_count(n_samples)


def list_udf(f: Callable[[np.ndarray], np.ndarray], samples: Column, dtype: str = "double") -> Column:
    """f of each signal, an array to an array."""

    @F.arrow_udf(f"array<{dtype}>")
    def apply(column: pa.Array) -> pa.Array:
        return pa.array([np.asarray(f(x.astype(np.float64, copy=False))) for x in signals(column)], pa.list_(pa.float64()))

    return apply(samples)


def spectrum(x: np.ndarray, n_fft: int) -> np.ndarray:
    if len(x) > n_fft:
        raise DimensionMismatch(n_fft, len(x))
    return np.fft.rfft(x, n_fft)


def istft(frames: np.ndarray, p: StftParams) -> np.ndarray:
    """Samples of half spectra (frames, bins)."""
    if frames.shape[1] != p.n_bins:
        raise DimensionMismatch(p.n_bins, frames.shape[1])
    w = p.window.values(p.n_fft)
    return _overlapped(np.fft.irfft(frames, p.n_fft, axis=1) * w, p.hop, w * w)[p.pad : (len(frames) - 1) * p.hop + p.n_fft - p.pad]


def _overlapped(rows: np.ndarray, hop: int, weight: np.ndarray | None = None) -> np.ndarray:
    size = (len(rows) - 1) * hop + rows.shape[1]
    at = (np.arange(len(rows))[:, None] * hop + np.arange(rows.shape[1])).ravel()
    out = np.bincount(at, rows.ravel(), size)
    if weight is not None:
        total = np.bincount(at, np.tile(weight, len(rows)), size)
        out = np.divide(out, total, out=out, where=total > 1e-10)
    return out


def mdct(x: np.ndarray, p: MdctParams) -> np.ndarray:
    """(frames, n): the definition as a product with its basis."""
    n = p.n
    require(len(x) >= p.window_size, "a signal is shorter than the window")
    rows = np.lib.stride_tricks.sliding_window_view(x, p.window_size)[:: p.hop] * p.window.values(p.window_size)
    return rows @ mdct_basis(n)


def mdct_basis(n: int) -> np.ndarray:
    return np.cos(np.pi / (4 * n) * ((2 * np.arange(2 * n)[:, None] + 1 + n) * (2 * np.arange(n)[None, :] + 1)))


def imdct(coefficients: np.ndarray, p: MdctParams, original_length: int | None = None) -> np.ndarray:
    if not len(coefficients):
        return np.zeros(0)
    if coefficients.shape[1] != p.n:
        raise DimensionMismatch(p.n, coefficients.shape[1])
    out = _overlapped(coefficients @ mdct_basis(p.n).T * (2 / p.n) * p.window.values(p.window_size), p.hop)
    return out if original_length is None else out[:original_length]


def minimum_phase(h: np.ndarray, length: int | None = None, oversample: int = 8) -> np.ndarray:
    """The minimum-phase response of h's magnitudes, by folding its real cepstrum."""
    require(len(h) > 0, "an impulse response must not be empty")
    length = len(h) if length is None else length
    require(length > 0, "the output has a sample at least")
    n = 1 << (len(h) * max(1, oversample) - 1).bit_length()
    size = np.abs(np.fft.fft(h, n)) ** 2
    floor = size.max() * 1e-20 if size.max() > 0 else 1e-300
    cepstrum = np.fft.ifft(0.5 * np.log(size + floor)).real
    # What is left of 0 is added to the right: both ends of the fold count once.
    fold = np.zeros(n)
    fold[0] = 1
    fold[1 : n // 2] = 2
    fold[n // 2] = 1
    return np.fft.ifft(np.exp(np.fft.fft(cepstrum * fold))).real[:length]


def gammatone_sections(fc: np.ndarray, sample_rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Numerators (4 sections, 2, bands) and common denominators (2, bands) of a fourth-order gammatone filter.

    Each section is T (z - e^(-BT)(cos t +- s sin t)) over one pair of poles; the first is divided by the gain at fc."""
    t = 1 / sample_rate
    b = 1.019 * 2 * np.pi * (fc / fb.EAR_Q + fb.ERB_BASE)
    angle, decay = 2 * np.pi * fc * t, np.exp(-b * t)
    offsets = np.array([1 + np.sqrt(2), -1 - np.sqrt(2), np.sqrt(2) - 1, 1 - np.sqrt(2)])[:, None]
    zeros = decay * (np.cos(angle) + offsets * np.sin(angle))
    poles = np.stack([-2 * np.cos(angle) * decay, decay**2])
    z = np.exp(1j * angle)
    # The gain of the cascade at its own centre: the response of all sections at z, poles included.
    response = np.prod(t * (1 - zeros / z), axis=0) / (1 + poles[0] / z + poles[1] / z**2) ** 4
    numerators = np.stack([np.full_like(zeros, t), -t * zeros], axis=1)
    numerators[0] /= np.abs(response)
    return numerators, poles


def gammatone(x: np.ndarray, sample_rate: float, frame_size: int, hop: int, e: ErbParams) -> np.ndarray:
    """(frames, bands): RMS of windowed frames through the filters, from rest in each frame."""
    require(sample_rate > 0, "the sample rate must be positive")
    require(len(x) >= frame_size, "a signal is shorter than a frame")
    from ..functions.windows import Window

    numerators, poles = gammatone_sections(fb.erb_axis(e), sample_rate)
    rows = np.lib.stride_tricks.sliding_window_view(x, frame_size)[::hop] * Window.hanning().values(frame_size)
    signal = np.repeat(rows[:, None, :], poles.shape[1], axis=1)  # frames, bands, samples
    for top, (n0, n1) in enumerate(numerators):
        out, s0, s1 = np.empty_like(signal), np.zeros(signal.shape[:2]), np.zeros(signal.shape[:2])
        for i in range(frame_size):
            v = signal[:, :, i]
            y = n0 * v + s0
            s0, s1 = n1 * v + s1 - poles[0] * y, -poles[1] * y
            out[:, :, i] = y
        signal = out
    level = np.sqrt((signal**2).mean(axis=2))
    return level if e.db_floor is None else 10 * np.log10(np.maximum(level, 10 ** (e.db_floor / 10)))


def cqt_free(x: np.ndarray, sample_rate: float, c: CqtParams, hop: int) -> np.ndarray:
    """(frames, bins) complex: frames of the signal's length, 16384 at most, without centring."""
    size = min(len(x), 16384)
    kernels = fb.cqt_matrix(sample_rate, c, size)
    return np.lib.stride_tricks.sliding_window_view(x, size)[::hop] @ kernels.T


def fft_convolve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = len(a) + len(b) - 1
    size = 1 << (n - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(a, size) * np.fft.rfft(b, size), size)[:n]


def convolve_2d(image: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Circular, the kernel's middle at the pixel."""
    require(kernel.shape[0] <= image.shape[0] and kernel.shape[1] <= image.shape[1], "the kernel must not exceed the image")
    wide = np.zeros(image.shape)
    wide[: kernel.shape[0], : kernel.shape[1]] = kernel
    wide = np.roll(wide, (-(kernel.shape[0] // 2), -(kernel.shape[1] // 2)), (0, 1))
    return np.fft.irfft2(np.fft.rfft2(image) * np.fft.rfft2(wide), image.shape)


def lowpass_mask(rows: int, cols: int, cutoff: float) -> np.ndarray:
    half = cols // 2 + 1
    r, c = np.arange(rows)[:, None], np.arange(half)[None, :]
    away = np.minimum(r, rows - r) ** 2 + np.minimum(c, half - c) ** 2
    return (away <= (min(rows // 2, half // 2) * cutoff) ** 2).astype(float)


def filter_2d(image: np.ndarray, mask: np.ndarray) -> np.ndarray:
    return np.fft.irfft2(np.fft.rfft2(image) * mask, image.shape)
