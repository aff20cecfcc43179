"""Builds plans: checks parameters and forms filterbanks once."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from ..errors import require
from ..operators import filterbanks as fb
from ..operators import spectro
from ..operators.fourier import BASIS_LIMIT
from ..params import ChromaParams, CqtParams, ErbParams, LogHzParams, LogParams, MelParams, MfccParams, SpectroParams
from ..sources.signals import to_long
from .vector import SpectroPlan

#: Most points of a frame for which the relational form is chosen.
SMALL = 8
FREQUENCIES = ("linear", "mel", "erb", "log_hz", "cqt")


class Planner:
    """Plans for all frequency and amplitude scales; names as linear_power, mel_db, cqt_magnitude ... give one each."""

    def plan(self, frequency: str, scale: str, p: SpectroParams, bands=None, log: LogParams | None = None) -> SpectroPlan:
        require(frequency in FREQUENCIES, f"the frequency scale must be one of {FREQUENCIES}")
        require(scale in spectro.AMPLITUDES, f"the amplitude must be one of {spectro.AMPLITUDES}")
        if frequency == "linear":
            return SpectroPlan(p, None, fb.bin_frequencies(p), False, scale, log)
        if frequency == "mel":
            return SpectroPlan(p, fb.mel_weights(p, bands), fb.mel_axis(p, bands), False, scale, log)
        if frequency == "erb":
            return SpectroPlan(p, fb.erb_weights(p, bands), fb.erb_axis(bands), False, scale, log)
        if frequency == "log_hz":
            return SpectroPlan(p, fb.log_hz_weights(p, bands), fb.log_hz_axis(bands), False, scale, log)
        require(bands.frequency(bands.n_bins - 1) < p.nyquist, "the highest bin must be below the Nyquist frequency")
        return SpectroPlan(p, fb.cqt_matrix(p.sample_rate, bands, p.stft.n_fft), np.array([bands.frequency(k) for k in range(bands.n_bins)]), True, scale, log)

    def __getattr__(self, name: str):
        frequency, _, scale = name.rpartition("_")
        if frequency not in FREQUENCIES or scale not in spectro.AMPLITUDES:
            raise AttributeError(name)
        if frequency == "linear":
            return lambda p, log=None: self.plan("linear", scale, p, None, log)
        return lambda p, bands, log=None: self.plan(frequency, scale, p, bands, log)


def compute(packed: DataFrame, frequency: str, scale: str, p: SpectroParams, bands=None, log: LogParams | None = None, relational: bool | None = None) -> DataFrame:
    """signal_id, frame, bin, value. Vectorised, unless the relational form is asked for, which takes up to BASIS_LIMIT points.

    Left open, the form goes by size: frames of SMALL points or fewer are relational, as their products are fewer than the rows that pass
    to Python and back."""
    if relational is None:
        relational = p.stft.n_fft <= SMALL
    require(not relational or p.stft.n_fft <= BASIS_LIMIT, "the relational form takes small transforms only")
    if not relational:
        return Planner().plan(frequency, scale, p, bands, log).long(packed)
    long = to_long(packed)
    if frequency == "linear":
        return spectro.linear(long, p, scale, log)
    return {"mel": spectro.mel, "erb": spectro.erb, "log_hz": spectro.log_hz, "cqt": spectro.cqt}[frequency](long, p, bands, scale, log)


class MfccPlan:
    """Coefficients (frames, n_mfcc) of packed signals, vectorised."""

    def __init__(self, p: SpectroParams, n_mels: int, m: MfccParams):
        self.base = Planner().mel_db(p, MelParams(n_mels, 0.0, p.nyquist), LogParams(-80.0))
        weights = fb.dct_weights(m.n_mfcc, n_mels)
        if m.lifter:
            weights = weights * (1 + m.lifter / 2 * np.sin(np.pi * np.arange(m.n_mfcc) / m.lifter))[:, None]
        self.weights = weights if m.include_c0 or m.n_mfcc == 1 else weights[1:]

    def matrix(self, x: np.ndarray) -> np.ndarray:
        return self.base.matrix(x) @ self.weights.T


class ChromaPlan:
    """Pitch classes (frames, 12) of packed signals, vectorised."""

    def __init__(self, p: SpectroParams, c: ChromaParams):
        self.base, self.norm, self.weights = Planner().linear_magnitude(p), c.norm, fb.chroma_weights(p, c)

    def matrix(self, x: np.ndarray) -> np.ndarray:
        out = self.base.matrix(x) @ self.weights.T
        if self.norm == "none":
            return out
        size = {"l1": lambda v: v.sum(axis=1), "l2": lambda v: np.sqrt((v * v).sum(axis=1)), "max": lambda v: v.max(axis=1)}[self.norm](out)[:, None]
        return np.divide(out, size, out=out.copy(), where=size > 0)


__all__ = ["ChromaPlan", "CqtParams", "ErbParams", "LogHzParams", "MfccPlan", "Planner", "compute"]
