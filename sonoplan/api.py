"""One-call functions over packed signals (signal_id, samples), by the names that users of such libraries know.

compute_{linear,mel,erb,loghz,cqt}_{power,magnitude,db}, compute_chromagram, compute_mfcc, compute_stft, compute_fft, compute_rfft,
compute_irfft, compute_istft, compute_power_spectrum, compute_magnitude_spectrum, compute_fft_c2c, compute_ifft_c2c,
compute_deconvolution, compute_modulation. Of packed stereo signals (pair_id, left, right): compute_{itd,ipd,ild,ilr}. Of packed
images (image_id, pixels): compute_fft2d, compute_ifft2d, compute_power_2d, compute_magnitude_2d, compute_lowpass, compute_highpass,
compute_bandpass, compute_edges, compute_sharpen, compute_convolve_2d. All are vectorised and shuffle nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import DimensionMismatch
from .functions.windows import Window
from .operators.spectro import AMPLITUDES
from .params import BinauralParams, ChromaParams, LogParams, MelParams, MfccParams, SpectroParams, StftParams
from .plans import spatial, vector
from .plans.planner import ChromaPlan, MfccPlan, Planner

_SCALES = {"linear": "linear", "mel": "mel", "erb": "erb", "loghz": "log_hz", "cqt": "cqt"}


def _one_shot(kind: str, scale: str):
    def compute(packed: DataFrame, params: SpectroParams, bands=None, db: LogParams | None = None, dtype: str = "double") -> DataFrame:
        return Planner().plan(_SCALES[kind], scale, params, bands, db).compute(packed, dtype)

    compute.__name__ = f"compute_{kind}_{scale}"
    compute.__doc__ = f"signal_id, frames: {kind} bands, {scale}; bands are the scale's parameters, db the floor."
    return compute


globals().update({f"compute_{k}_{s}": _one_shot(k, s) for k in _SCALES for s in AMPLITUDES})


def _matrices(packed: DataFrame, f, name: str = "frames") -> DataFrame:
    @F.arrow_udf("array<array<double>>")
    def apply(column: pa.Array) -> pa.Array:
        return pa.array([list(f(x.astype(float, copy=False))) for x in vector.signals(column)], pa.list_(pa.list_(pa.float64())))

    return packed.select("signal_id", apply("samples").alias(name))


def _complex(packed: DataFrame, f) -> DataFrame:
    """signal_id, re, im of a complex function of each signal."""

    @F.arrow_udf("struct<re: array<double>, im: array<double>>")
    def apply(column: pa.Array) -> pa.Array:
        found = [f(x.astype(float, copy=False)) for x in vector.signals(column)]
        return pa.StructArray.from_arrays([pa.array([getattr(z, part) for z in found], pa.list_(pa.float64())) for part in ("real", "imag")], ["re", "im"])

    return packed.select("signal_id", apply("samples").alias("z")).select("signal_id", "z.re", "z.im")


def compute_chromagram(packed: DataFrame, params: SpectroParams, chroma: ChromaParams) -> DataFrame:
    return _matrices(packed, ChromaPlan(params, chroma).matrix)


def compute_mfcc(packed: DataFrame, params: SpectroParams, n_mels: int, mfcc: MfccParams) -> DataFrame:
    return _matrices(packed, MfccPlan(params, n_mels, mfcc).matrix)


def compute_stft(packed: DataFrame, params: StftParams) -> DataFrame:
    """signal_id, re, im: arrays of frames times bins, frame by frame."""
    return _complex(packed, lambda x: np.fft.rfft(vector.framed(x, params), axis=1).ravel())


def compute_istft(spectra: DataFrame, params: StftParams) -> DataFrame:
    """signal_id, samples of what compute_stft gave."""

    @F.arrow_udf("array<double>")
    def apply(re: pa.Array, im: pa.Array) -> pa.Array:
        return pa.array([vector.istft((a + 1j * b).reshape(-1, params.n_bins), params) for a, b in zip(vector.signals(re), vector.signals(im), strict=True)], pa.list_(pa.float64()))

    return spectra.select("signal_id", apply("re", "im").alias("samples"))


def compute_fft(packed: DataFrame, n_fft: int) -> DataFrame:
    return _complex(packed, lambda x: vector.spectrum(x, n_fft))


def compute_rfft(packed: DataFrame, n_fft: int) -> DataFrame:
    """Magnitudes."""
    return packed.select("signal_id", vector.list_udf(lambda x: np.abs(vector.spectrum(x, n_fft)), F.col("samples")).alias("magnitudes"))


def compute_irfft(spectra: DataFrame, n_fft: int) -> DataFrame:
    """signal_id, samples of half spectra (re, im) of n_fft / 2 + 1 bins exactly."""

    def one(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if len(a) != n_fft // 2 + 1:
            raise DimensionMismatch(n_fft // 2 + 1, len(a))
        return np.fft.irfft(a + 1j * b, n_fft)

    @F.arrow_udf("array<double>")
    def apply(re: pa.Array, im: pa.Array) -> pa.Array:
        return pa.array([one(a, b) for a, b in zip(vector.signals(re), vector.signals(im), strict=True)], pa.list_(pa.float64()))

    return spectra.select("signal_id", apply("re", "im").alias("samples"))


def compute_power_spectrum(packed: DataFrame, n_fft: int, window: Window | None = None) -> DataFrame:
    w = (window or Window.rectangular()).values(n_fft)

    def one(x: np.ndarray) -> np.ndarray:
        if len(x) > n_fft:
            raise DimensionMismatch(n_fft, len(x))
        return vector.power((np.pad(x, (0, n_fft - len(x))) * w)[None, :])[0]

    return packed.select("signal_id", vector.list_udf(one, F.col("samples")).alias("power"))


def compute_magnitude_spectrum(packed: DataFrame, n_fft: int, window: Window | None = None) -> DataFrame:
    return compute_power_spectrum(packed, n_fft, window).select("signal_id", F.transform("power", F.sqrt).alias("magnitudes"))


def fft_c2c(z: np.ndarray) -> np.ndarray:
    """Complex transform, unnormalised."""
    return np.fft.fft(z)


def ifft_c2c(z: np.ndarray) -> np.ndarray:
    """Its inverse, unnormalised too: forward and back multiplies by the length."""
    return np.fft.ifft(z) * len(z)


def compute_fft_c2c(packed: DataFrame) -> DataFrame:
    """signal_id, re, im of packed complex signals (re, im), unnormalised."""
    return spatial.c2c(packed)


def compute_ifft_c2c(packed: DataFrame) -> DataFrame:
    return spatial.c2c(packed, True)


def compute_deconvolution(packed: DataFrame, regularization: float) -> DataFrame:
    """signal_id, samples of the quotient of packed signals (numerator, denominator) of any length."""

    @F.arrow_udf("array<double>")
    def apply(top: pa.Array, low: pa.Array) -> pa.Array:
        return pa.array([spatial.deconvolve(a, b, regularization) for a, b in zip(vector.signals(top), vector.signals(low), strict=True)], pa.list_(pa.float64()))

    return packed.select("signal_id", apply("numerator", "denominator").alias("samples"))


def compute_modulation(packed: DataFrame, params: SpectroParams, mels: MelParams) -> DataFrame:
    """image_id, r, c, v."""
    return spatial.ModulationPlan(params, mels).long(packed)


def _cue(name: str):
    def compute(packed: DataFrame, params: BinauralParams) -> DataFrame:
        return spatial.BinauralPlan(params, name).compute(packed)

    compute.__name__, compute.__doc__ = f"compute_{name}", f"pair_id, frames: {name} in {spatial.UNITS[name]}."
    return compute


def _of_images(name: str):
    def compute(packed: DataFrame, shape: tuple[int, int], *args) -> DataFrame:
        return getattr(spatial.ImagePlan(*shape), name)(packed, *args)

    compute.__doc__ = getattr(spatial.ImagePlan, name).__doc__
    return compute


globals().update({f"compute_{n}": _cue(n) for n in spatial.UNITS})
globals().update({f"compute_{n}": _of_images(n) for n in ("fft2d", "ifft2d", "lowpass", "highpass", "bandpass", "edges", "sharpen")})
globals().update({"compute_power_2d": _of_images("power"), "compute_magnitude_2d": _of_images("magnitude"), "compute_convolve_2d": _of_images("convolve")})
