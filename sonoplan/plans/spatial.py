"""Vectorised plans for two channels, for images and for quotients: one Arrow function over packed rows, of any size that one row holds.

Stereo: pair_id, left, right (arrays of equal length). Images: image_id, pixels (array, row by row; all of one shape that the plan
names). No shuffle: each row gives its result's row. The long forms give the same rows as the relational operators.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DimensionMismatch, require
from ..operators import filterbanks as fb
from ..params import BinauralParams, MelParams, SpectroParams
from . import vector

#: Units of the cues, as axis labels say them.
UNITS = {"itd": "s", "ipd": "rad", "ild": "dB", "ilr": "ratio"}


def _lists(found: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([x.size for x in found])))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([x.ravel() for x in found]) if found else np.zeros(0), pa.float64()))


def magphase(z: np.ndarray, power: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Magnitudes to a power, and phases on the unit circle; 0 has magnitude 0 and phase 1 + 0j."""
    size = np.abs(z)
    return np.where(size > 0, size, 0.0) ** power, np.divide(z, size, out=np.ones_like(z), where=size > 0)


def _angle(z: np.ndarray) -> np.ndarray:
    return np.where(z == 0, 0.0, np.angle(z))


def wrap(angle: np.ndarray) -> np.ndarray:
    """Into [-pi, pi)."""
    turn = 2 * math.pi
    return angle + math.pi - np.floor((angle + math.pi) / turn) * turn - math.pi


def cue_of(cue: str, p: BinauralParams, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """(frames, bins of the band) of one cue from two spectra of these bins; masked cells are NaN."""
    if cue in ("itd", "ipd"):
        phase = _angle(left) - _angle(right)
        if cue == "ipd":
            return wrap(phase) if p.wrapped else phase
        heard = (np.abs(left) ** p.power > 0) | (np.abs(right) ** p.power > 0)
        return np.where(heard, wrap(phase) / (2 * math.pi * p.spectro.resolution * np.array(p.without_dc())), 0.0)
    l, r = np.abs(left), np.abs(right)
    both = (l > 0) & (r > 0)
    l, r = np.where(both, l, 1.0), np.where(both, r, 1.0)
    value = -20 * np.log10(r / l) if cue == "ild" else np.where(r < l, 1 - r / l, l / r - 1)
    return np.where(both, value, np.nan)


@dataclass(frozen=True)
class BinauralPlan:
    """One cue (itd, ipd, ild or ilr) of packed stereo signals."""

    params: BinauralParams
    cue: str

    def __post_init__(self):
        require(self.cue in UNITS, f"the cue must be one of {sorted(UNITS)}")

    @property
    def unit(self) -> str:
        return UNITS[self.cue]

    @property
    def bins(self) -> range:
        return self.params.without_dc() if self.cue == "itd" else self.params.bins

    def matrix(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if len(left) != len(right):
            raise DimensionMismatch(len(left), len(right))
        p, band = self.params.spectro.stft, slice(self.bins.start, self.bins.stop)
        last, step = p.frame_count(len(left)), max(1, vector.BLOCK // p.n_fft)
        out = []
        for k in range(0, last, step):
            l, r = (np.fft.rfft(vector.framed(x, p, True, k, min(last, k + step) - 1), axis=1)[:, band] for x in (left, right))
            out.append(cue_of(self.cue, self.params, l, r))
        return np.concatenate(out)

    def compute(self, packed: DataFrame) -> DataFrame:
        """pair_id, frames (array of arrays of the band's bins)."""
        own = self

        @F.arrow_udf("array<array<double>>")
        def apply(left: pa.Array, right: pa.Array) -> pa.Array:
            found = [own.matrix(l.astype(float), r.astype(float)) for l, r in zip(vector.signals(left), vector.signals(right), strict=True)]
            counts = np.array([len(m) for m in found])
            inner = pa.ListArray.from_arrays(pa.array(np.arange(counts.sum() + 1) * len(own.bins), pa.int32()), pa.array(np.concatenate([m.ravel() for m in found]), pa.float64()))
            return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), inner)

        return packed.select("pair_id", apply("left", "right").alias("frames"))

    def long(self, packed: DataFrame) -> DataFrame:
        """pair_id, frame, bin, value: what histograms and comparisons take."""
        each = self.compute(packed).select("pair_id", F.posexplode("frames").alias("frame", "bands"))
        each = each.select("pair_id", "frame", F.posexplode("bands").alias("bin", "value"))
        return each.select("pair_id", "frame", (F.col("bin") + self.bins.start).alias("bin"), "value")


def pack_pairs(packed: DataFrame, pair: Column, side: Column) -> DataFrame:
    """pair_id, left, right of packed signals (samples) that have both sides; side is 0 for the left one."""
    both = packed.groupBy(pair.alias("pair_id")).agg(F.max(F.when(side == 0, F.col("samples"))).alias("left"), F.max(F.when(side == 1, F.col("samples"))).alias("right"))
    return both.where("left is not null and right is not null")


def highpass_mask(rows: int, cols: int, cutoff: float) -> np.ndarray:
    return 1 - vector.lowpass_mask(rows, cols, cutoff)


def _share(x: float, what: str) -> None:
    require(0 <= x <= 1, f"{what} must be from 0 to 1")


@dataclass(frozen=True)
class ImagePlan:
    """Transforms and filters of packed images of one shape; a plan holds its mask or kernel, formed once."""

    rows: int
    cols: int

    def __post_init__(self):
        require(self.rows > 0 and self.cols > 0, "an image has a row and a column at least")

    @property
    def spectrum_shape(self) -> tuple[int, int]:
        return self.rows, self.cols // 2 + 1

    def _image(self, x: np.ndarray) -> np.ndarray:
        if len(x) != self.rows * self.cols:
            raise DimensionMismatch(self.rows * self.cols, len(x))
        return x.astype(float).reshape(self.rows, self.cols)

    def map(self, packed: DataFrame, f: Callable[[np.ndarray], np.ndarray], name: str = "pixels") -> DataFrame:
        """image_id and f of each image, row by row."""
        own = self

        @F.arrow_udf("array<double>")
        def apply(column: pa.Array) -> pa.Array:
            return _lists([f(own._image(x)) for x in vector.signals(column)])

        return packed.select("image_id", apply("pixels").alias(name))

    def fft2d(self, packed: DataFrame) -> DataFrame:
        """image_id, re, im: half spectra, unnormalised, row by row."""
        own = self

        @F.arrow_udf("struct<re: array<double>, im: array<double>>")
        def apply(column: pa.Array) -> pa.Array:
            found = [np.fft.rfft2(own._image(x)) for x in vector.signals(column)]
            return pa.StructArray.from_arrays([_lists([z.real for z in found]), _lists([z.imag for z in found])], ["re", "im"])

        return packed.select("image_id", apply("pixels").alias("z")).select("image_id", "z.re", "z.im")

    def ifft2d(self, spectra: DataFrame) -> DataFrame:
        """image_id, pixels of half spectra (re, im)."""
        own = self

        def one(re: np.ndarray, im: np.ndarray) -> np.ndarray:
            if len(re) != math.prod(own.spectrum_shape):
                raise DimensionMismatch(math.prod(own.spectrum_shape), len(re))
            return np.fft.irfft2((re + 1j * im).reshape(own.spectrum_shape), (own.rows, own.cols))

        @F.arrow_udf("array<double>")
        def apply(re: pa.Array, im: pa.Array) -> pa.Array:
            return _lists([one(a, b) for a, b in zip(vector.signals(re), vector.signals(im), strict=True)])

        return spectra.select("image_id", apply("re", "im").alias("pixels"))

    def power(self, packed: DataFrame) -> DataFrame:
        return self.map(packed, lambda x: np.abs(np.fft.rfft2(x)) ** 2, "power")

    def magnitude(self, packed: DataFrame) -> DataFrame:
        return self.map(packed, lambda x: np.abs(np.fft.rfft2(x)), "magnitudes")

    def filtered(self, packed: DataFrame, mask: np.ndarray) -> DataFrame:
        return self.map(packed, lambda x: vector.filter_2d(x, mask))

    def lowpass(self, packed: DataFrame, cutoff: float) -> DataFrame:
        _share(cutoff, "the cut-off")
        return self.filtered(packed, vector.lowpass_mask(self.rows, self.cols, cutoff))

    def highpass(self, packed: DataFrame, cutoff: float) -> DataFrame:
        _share(cutoff, "the cut-off")
        return self.filtered(packed, highpass_mask(self.rows, self.cols, cutoff))

    def bandpass(self, packed: DataFrame, low: float, high: float) -> DataFrame:
        _share(low, "the lower cut-off")
        _share(high, "the upper cut-off")
        require(low < high, "the lower cut-off must be below the upper one")
        return self.filtered(packed, vector.lowpass_mask(self.rows, self.cols, high) - vector.lowpass_mask(self.rows, self.cols, low))

    def edges(self, packed: DataFrame) -> DataFrame:
        return self.highpass(packed, 0.1)

    def sharpen(self, packed: DataFrame, amount: float) -> DataFrame:
        require(amount >= 0, "the amount must not be negative")
        mask = highpass_mask(self.rows, self.cols, 0.2)
        return self.map(packed, lambda x: x + amount * vector.filter_2d(x, mask))

    def convolve(self, packed: DataFrame, kernel: np.ndarray) -> DataFrame:
        """Circular, the kernel's middle at the pixel."""
        return self.map(packed, lambda x: vector.convolve_2d(x, np.asarray(kernel, float)))

    def shifted(self, packed: DataFrame, inverse: bool = False) -> DataFrame:
        by = [(n + 1) // 2 if inverse else n // 2 for n in (self.rows, self.cols)]
        return self.map(packed, lambda x: np.roll(x, (-by[0], -by[1]), (0, 1)))

    def long(self, result: DataFrame, half: bool = False, names: dict[str, str] | None = None) -> DataFrame:
        """image_id, r, c and the values of a result's arrays (renamed by names): the rows of the relational operators."""
        width = self.cols // 2 + 1 if half else self.cols
        names = names or {c: "v" for c in result.columns if c != "image_id"}
        each = result.select("image_id", F.posexplode(F.arrays_zip(*(F.col(c).alias(n) for c, n in names.items()))).alias("i", "x"))
        return each.select("image_id", F.floor(F.col("i") / width).cast("int").alias("r"), (F.col("i") % width).cast("int").alias("c"), *(F.col(f"x.{n}").alias(n) for n in names.values()))


def pack_images(long: DataFrame, rows: int, cols: int) -> DataFrame:
    """image_id, pixels of long images (image_id, r, c, v); missing pixels are 0."""
    own = F.map_from_entries(F.collect_list(F.struct(F.col("r") * cols + F.col("c"), "v")))
    return long.groupBy("image_id").agg(own.alias("m")).select("image_id", F.transform(F.sequence(F.lit(0), F.lit(rows * cols - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("pixels"))


def gaussian_kernel(size: int, sigma: float) -> np.ndarray:
    """Weights that sum to 1."""
    require(size > 0 and size % 2 == 1, "the kernel's size must be odd")
    require(sigma > 0, "sigma must be positive")
    one = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma * sigma))
    out = np.outer(one, one)
    return out / out.sum()


def deconvolve(top: np.ndarray, low: np.ndarray, regularization: float) -> np.ndarray:
    """N conj(D) / (|D|^2 + regularization max |D|^2), circular at the next power of two; as long as the quotient, or as top if that is shorter than low."""
    require(len(top) > 0 and len(low) > 0, "a quotient needs two signals")
    require(regularization >= 0, "the regularisation must not be negative")
    n = 1 << (max(len(top), len(low)) - 1).bit_length()
    a, b = np.fft.rfft(top, n), np.fft.rfft(low, n)
    size = np.abs(b) ** 2
    q = size + regularization * size.max()
    z = np.divide(a * np.conj(b), q, out=np.zeros_like(a), where=q != 0)
    return np.fft.irfft(z, n)[: max(1, len(top) - len(low) + 1 if len(top) >= len(low) else len(top))]


@dataclass(frozen=True)
class ModulationPlan:
    """Spectro-temporal modulation: magnitudes of the two-dimensional spectrum of mel powers, zero frequencies in the middle."""

    params: SpectroParams
    mels: MelParams

    def matrix(self, x: np.ndarray) -> np.ndarray:
        image = vector.SpectroPlan(self.params, fb.mel_weights(self.params, self.mels)).matrix(x).T
        z = np.abs(np.fft.rfft2(image))
        return np.roll(z, (-(z.shape[0] // 2), -(z.shape[1] // 2)), (0, 1))

    def long(self, packed: DataFrame) -> DataFrame:
        """image_id, r, c, v of packed signals (signal_id, samples) of any length."""
        own = self

        @F.arrow_udf("struct<width: int, v: array<double>>")
        def apply(column: pa.Array) -> pa.Array:
            found = [own.matrix(x.astype(float)) for x in vector.signals(column)]
            return pa.StructArray.from_arrays([pa.array([m.shape[1] for m in found], pa.int32()), _lists(found)], ["width", "v"])

        each = packed.select(F.col("signal_id").alias("image_id"), apply("samples").alias("m")).select("image_id", "m.width", F.posexplode("m.v").alias("i", "v"))
        return each.select("image_id", F.floor(F.col("i") / F.col("width")).cast("int").alias("r"), (F.col("i") % F.col("width")).cast("int").alias("c"), "v")


def c2c(packed: DataFrame, inverse: bool = False) -> DataFrame:
    """signal_id, re, im: the complex transform of packed complex signals (re, im), unnormalised both ways."""

    def one(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if len(a) != len(b):
            raise DimensionMismatch(len(a), len(b))
        z = a + 1j * b
        return np.fft.ifft(z) * len(z) if inverse else np.fft.fft(z)

    @F.arrow_udf("struct<re: array<double>, im: array<double>>")
    def apply(re: pa.Array, im: pa.Array) -> pa.Array:
        found = [one(a, b) for a, b in zip(vector.signals(re), vector.signals(im), strict=True)]
        return pa.StructArray.from_arrays([_lists([z.real for z in found]), _lists([z.imag for z in found])], ["re", "im"])

    return packed.select("signal_id", apply("re", "im").alias("z")).select("signal_id", "z.re", "z.im")
