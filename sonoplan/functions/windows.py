"""Analysis windows: values for vectorised code, expressions for relational code, and their text form.

All windows are symmetric (period N - 1), as in the definition N = 1 is undefined for Hann, Hamming and Blackman.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidInput, require

#: Polynomials of the modified Bessel function I0 (Abramowitz and Stegun 9.8.1 and 9.8.2), lowest power first.
BESSEL_NEAR = [1.0, 3.5156229, 3.0899424, 1.2067492, 0.2659732, 0.0360768, 0.0045813]
BESSEL_FAR = [0.39894228, 0.01328592, 0.00225319, -0.00157565, 0.00916281, -0.02057706, 0.02635537, -0.01647633, 0.00392377]
#: Where the second polynomial takes over, and its factor 1/sqrt(2 pi) is already in its coefficients.
BESSEL_EDGE = 3.75

_FORM = re.compile(r"(rect|rectangle|rectangular|hann|hanning|hamm|hamming|blackman)|(kaiser|gaussian)=([0-9]*\.?[0-9]+)", re.IGNORECASE)


def bessel_i0(x: np.ndarray) -> np.ndarray:
    """I0 by the published polynomials. The far one is divided by sqrt(x) and, as the rebuilt library does, by sqrt(2 pi) too."""
    x = np.abs(np.asarray(x, dtype=float))
    near = np.polyval(BESSEL_NEAR[::-1], (np.minimum(x, BESSEL_EDGE) / BESSEL_EDGE) ** 2)
    far_x = np.maximum(x, BESSEL_EDGE)
    far = np.exp(far_x) / (np.sqrt(far_x) * math.sqrt(2 * math.pi)) * np.polyval(BESSEL_FAR[::-1], BESSEL_EDGE / far_x)
    return np.where(x <= BESSEL_EDGE, near, far)


def _bessel_column(x: Column) -> Column:
    def horner(coefficients: list[float], t: Column) -> Column:
        out = F.lit(coefficients[-1])
        for c in reversed(coefficients[:-1]):
            out = out * t + F.lit(c)
        return out

    a = F.abs(x)
    t = a / F.lit(BESSEL_EDGE)
    far = F.exp(a) / (F.sqrt(F.greatest(a, F.lit(BESSEL_EDGE))) * F.lit(math.sqrt(2 * math.pi))) * horner(BESSEL_FAR, F.lit(BESSEL_EDGE) / F.greatest(a, F.lit(BESSEL_EDGE)))
    return F.when(a <= BESSEL_EDGE, horner(BESSEL_NEAR, t * t)).otherwise(far)


@dataclass(frozen=True)
class Window:
    """kind: rectangular, hanning, hamming, blackman, kaiser (beta), gaussian (std in samples) or custom."""

    kind: str = "hanning"
    parameter: float | None = None
    coefficients: tuple[float, ...] | None = None

    @staticmethod
    def rectangular() -> Window:
        return Window("rectangular")

    @staticmethod
    def hanning() -> Window:
        return Window("hanning")

    @staticmethod
    def hamming() -> Window:
        return Window("hamming")

    @staticmethod
    def blackman() -> Window:
        return Window("blackman")

    @staticmethod
    def kaiser(beta: float) -> Window:
        return Window("kaiser", float(beta))

    @staticmethod
    def gaussian(std: float) -> Window:
        return Window("gaussian", float(std))

    @staticmethod
    def custom(coefficients, normalize: str | None = None) -> Window:
        """normalize: sum, peak (or max), energy (or rms), or None."""
        values = np.asarray(list(coefficients), dtype=float)
        require(len(values) > 0, "a custom window needs coefficients")
        require(bool(np.isfinite(values).all()), "a custom window's coefficients must be finite")
        if normalize is not None:
            by = {"sum": values.sum, "peak": values.max, "max": values.max, "energy": lambda: math.sqrt((values * values).sum()), "rms": lambda: math.sqrt((values * values).sum())}
            require(normalize.lower() in by, f"unknown normalisation {normalize!r}")
            scale = float(by[normalize.lower()]())
            require(scale != 0, "the window cannot be normalised: its measure is 0")
            values = values / scale
        return Window("custom", None, tuple(values.tolist()))

    @staticmethod
    def parse(text: str) -> Window:
        m = _FORM.fullmatch(text.strip())
        if not m:
            raise InvalidInput(f"not a window: {text!r}")
        if m[1]:
            return Window({"r": "rectangular", "b": "blackman"}.get(m[1][0].lower()) or {"hann": "hanning", "hamm": "hamming"}[m[1][:4].lower()])
        return Window(m[2].lower(), float(m[3]))

    @property
    def is_parameterized(self) -> bool:
        return self.kind in ("kaiser", "gaussian")

    def __str__(self) -> str:
        if self.kind == "custom":
            return f"custom[{len(self.coefficients)}]"
        return f"{self.kind}={self.parameter:g}" if self.is_parameterized else self.kind

    def values(self, n: int) -> np.ndarray:
        require(n > 0, "a window has at least one value")
        i = np.arange(n, dtype=float)
        if self.kind == "custom":
            require(len(self.coefficients) == n, f"the custom window has {len(self.coefficients)} values, not {n}")
            return np.array(self.coefficients)
        if self.kind == "rectangular":
            return np.ones(n)
        if self.kind == "kaiser":
            if n == 1:
                return np.ones(1)
            half = (n - 1) / 2
            return bessel_i0(self.parameter * np.sqrt(np.maximum(0, 1 - ((i - half) / half) ** 2))) / bessel_i0(self.parameter)
        if self.kind == "gaussian":
            return np.exp(-0.5 * ((i - (n - 1) / 2) / self.parameter) ** 2)
        with np.errstate(invalid="ignore", divide="ignore"):
            a = 2 * np.pi * i / (n - 1)
            if self.kind == "hanning":
                return 0.5 - 0.5 * np.cos(a)
            if self.kind == "hamming":
                return 0.54 - 0.46 * np.cos(a)
            return 0.42 - 0.5 * np.cos(a) + 0.08 * np.cos(2 * a)

    def column(self, i: Column, n: int) -> Column:
        """The window's value at i of n, as an expression."""
        if self.kind == "custom":
            return F.element_at(F.array(*(F.lit(float(x)) for x in self.values(n))), i.cast("int") + 1)
        if self.kind == "rectangular" or (self.kind == "kaiser" and n == 1):
            return F.lit(1.0)
        i = i.cast("double")
        if self.kind == "kaiser":
            half = (n - 1) / 2
            u = (i - F.lit(half)) / F.lit(half)
            return _bessel_column(F.lit(self.parameter) * F.sqrt(F.greatest(F.lit(0.0), 1 - u * u))) / F.lit(float(bessel_i0(self.parameter)))
        if self.kind == "gaussian":
            u = (i - F.lit((n - 1) / 2)) / F.lit(self.parameter)
            return F.exp(F.lit(-0.5) * u * u)
        require(n > 1, f"a {self.kind} window of one value is undefined")
        a = F.lit(2 * math.pi) * i / F.lit(float(n - 1))
        if self.kind == "hanning":
            return F.lit(0.5) - F.lit(0.5) * F.cos(a)
        if self.kind == "hamming":
            return F.lit(0.54) - F.lit(0.46) * F.cos(a)
        return F.lit(0.42) - F.lit(0.5) * F.cos(a) + F.lit(0.08) * F.cos(2 * a)

    def table(self, spark: SparkSession, n: int) -> DataFrame:
        """i, w."""
        return spark.range(n).select(F.col("id").cast("int").alias("i"), self.column(F.col("id"), n).alias("w"))
