"""Transformers: any signal table to bands and frames, by one protocol."""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import filterbanks as fb
from ..params import PITCH_CLASSES, ChromaParams, CqtParams, ErbParams, MfccParams, SpectroParams
from ..plans import vector
from ..plans.planner import ChromaPlan, MfccPlan, Planner


class Transformer(Protocol):
    def matrix(self, x: np.ndarray) -> np.ndarray: ...
    def n_bands(self) -> int: ...
    def centre_frequencies(self) -> np.ndarray: ...
    def sample_rate(self) -> float: ...
    def hop_seconds(self) -> float: ...
    def transform(self, packed: DataFrame) -> DataFrame: ...


class _Base:
    """transform: signal_id, frame, bands (array) of packed signals."""

    def __init__(self, matrix, n: int, frequencies: np.ndarray, rate: float, hop: float):
        self.matrix, self._n, self._f, self._rate, self._hop = matrix, n, frequencies, rate, hop

    def n_bands(self) -> int:
        return self._n

    def centre_frequencies(self) -> np.ndarray:
        return self._f

    def sample_rate(self) -> float:
        return self._rate

    def hop_seconds(self) -> float:
        return self._hop

    def transform(self, packed: DataFrame) -> DataFrame:
        matrix = self.matrix

        @F.arrow_udf("array<array<double>>")
        def apply(column: pa.Array) -> pa.Array:
            return pa.array([list(matrix(x)) for x in vector.signals(column)], pa.list_(pa.list_(pa.float64())))

        return packed.select("signal_id", F.posexplode(apply("samples")).alias("frame", "bands"))


def planned(frequency: str, scale: str, p: SpectroParams, bands=None, log=None) -> _Base:
    plan = Planner().plan(frequency, scale, p, bands, log)
    return _Base(plan.matrix, plan.n_bands, plan.frequencies, p.sample_rate, p.period)


def gammatone(sample_rate: float, frame_size: int, hop: int, e: ErbParams) -> _Base:
    return _Base(lambda x: vector.gammatone(x, sample_rate, frame_size, hop, e), e.n_filters, fb.erb_axis(e), sample_rate, hop / sample_rate)


def cqt_magnitude(p: SpectroParams, c: CqtParams) -> _Base:
    return planned("cqt", "magnitude", p, c)


def chroma(p: SpectroParams, c: ChromaParams) -> _Base:
    return _Base(ChromaPlan(p, c).matrix, len(PITCH_CLASSES), np.arange(12.0), p.sample_rate, p.period)


def mfcc(p: SpectroParams, n_mels: int, m: MfccParams) -> _Base:
    """n_bands is the number of rows that come out, c0 left out or not."""
    plan = MfccPlan(p, n_mels, m)
    return _Base(plan.matrix, len(plan.weights), np.arange(float(len(plan.weights))), p.sample_rate, p.period)
