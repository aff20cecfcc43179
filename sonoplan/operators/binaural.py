"""Two-channel localisation cues: time, phase and level differences, their histograms and comparisons.

Both channels are transformed in one grouped sum (a sample has a left and a right value), so nothing is joined; only bins
of the wanted band are formed. Masked cells are NaN.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import require
from ..params import BinauralParams, SpectroParams
from .fourier import basis, frames

NAN = float("nan")
#: Seconds of delay that count as 90 degrees.
SIDE = 0.00086


def spectra(stereo: DataFrame, p: SpectroParams, bins: range, length: int | None = None) -> DataFrame:
    """pair_id, frame, bin, lr, li, rr, ri of stereo signals (pair_id, n, left, right)."""
    both = stereo.select("pair_id", "n", F.struct("left", "right").alias("x"))
    n_fft = p.stft.n_fft
    # Framing multiplies x by the window, so it is asked for unwindowed and the window is applied to both sides here.
    framed = frames(both, p.stft, False, length, "pair_id")
    w = p.stft.window.column(F.col("i"), n_fft)
    b = basis(stereo.sparkSession, n_fft, bins.start, bins.stop - 1).withColumnRenamed("i", "_i")
    parts = framed.select("pair_id", "frame", "i", (F.col("v.left") * w).alias("l"), (F.col("v.right") * w).alias("r")).join(F.broadcast(b), F.col("i") == F.col("_i"))
    dot = lambda side, part, sign: (F.sum(F.col(side) * F.col(part)) * F.lit(float(sign))).alias(f"{side}{'r' if part == 'bc' else 'i'}")
    return parts.groupBy("pair_id", "frame", F.col("k").alias("bin")).agg(dot("l", "bc", 1), dot("l", "bs", -1), dot("r", "bc", 1), dot("r", "bs", -1))


def magphase(re: Column, im: Column, power: float = 1.0) -> tuple[Column, Column, Column]:
    """Magnitude to a power, and the phase as a point on the unit circle; 0 has magnitude 0 and phase 1 + 0j."""
    size = F.sqrt(re * re + im * im)
    some = size > 0
    raised = size if power == 1 else F.pow(size, F.lit(float(power)))
    return F.when(some, raised).otherwise(0.0), F.when(some, F.try_divide(re, size)).otherwise(1.0), F.when(some, F.try_divide(im, size)).otherwise(0.0)


def _angle(re: Column, im: Column) -> Column:
    return F.when((re == 0) & (im == 0), F.lit(0.0)).otherwise(F.atan2(im, re))


def wrap(angle: Column) -> Column:
    """Into [-pi, pi)."""
    turn = 2 * math.pi
    return angle + F.lit(math.pi) - F.floor((angle + F.lit(math.pi)) / F.lit(turn)) * F.lit(turn) - F.lit(math.pi)


def _sizes() -> tuple[Column, Column]:
    l, r = F.col("lr") * F.col("lr") + F.col("li") * F.col("li"), F.col("rr") * F.col("rr") + F.col("ri") * F.col("ri")
    return F.sqrt(l), F.sqrt(r)


def _cells(stereo: DataFrame, p: BinauralParams, bins: range, value: Column, length: int | None) -> DataFrame:
    return spectra(stereo, p.spectro, bins, length).select("pair_id", "frame", "bin", value.alias("value"))


def time_difference(stereo: DataFrame, p: BinauralParams, length: int | None = None) -> DataFrame:
    """Seconds; 0 where both sides are silent. The power only matters to that mask."""
    l, r = _sizes()
    some = (F.pow(l, F.lit(float(p.power))) > 0) | (F.pow(r, F.lit(float(p.power))) > 0)
    phase = wrap(_angle(F.col("lr"), F.col("li")) - _angle(F.col("rr"), F.col("ri")))
    value = F.when(some, phase / (F.lit(2 * math.pi * p.spectro.resolution) * F.col("bin"))).otherwise(0.0)
    return _cells(stereo, p, p.without_dc(), value, length)


def phase_difference(stereo: DataFrame, p: BinauralParams, length: int | None = None) -> DataFrame:
    phase = _angle(F.col("lr"), F.col("li")) - _angle(F.col("rr"), F.col("ri"))
    return _cells(stereo, p, p.bins, wrap(phase) if p.wrapped else phase, length)


def level_difference(stereo: DataFrame, p: BinauralParams, length: int | None = None) -> DataFrame:
    """dB; NaN unless both sides sound."""
    l, r = _sizes()
    both = (l > 0) & (r > 0)
    return _cells(stereo, p, p.bins, F.when(both, F.lit(-20.0) * F.log10(F.try_divide(r, l))).otherwise(F.lit(NAN)), length)


def level_ratio(stereo: DataFrame, p: BinauralParams, length: int | None = None) -> DataFrame:
    """1 - right / left, or left / right - 1 if the right side is louder; NaN unless both sides sound."""
    l, r = _sizes()
    value = F.when((l > 0) & (r > 0), F.when(r < l, 1 - F.try_divide(r, l)).otherwise(F.try_divide(l, r) - 1)).otherwise(F.lit(NAN))
    return _cells(stereo, p, p.bins, value, length)


#: Fixed values of histograms: range and exponent of each cue.
HISTOGRAMS = {"time": (0.00088, 1.0), "phase": (math.pi, 1.0), "level": (24.0, 3.0), "ratio": (1.0, 3.0)}


def histogram(cells: DataFrame, cue: str, n_bins: int = 400, limit: float | None = None, exponent: float | None = None, normalize: bool = False, energy_weighted: bool = False) -> DataFrame:
    """pair_id, frame, bin, value: counts from -limit to limit in each frame, raised to the exponent; every bin has a row.

    Values outside and such that are not finite are passed over; the upper limit falls into the last bin; energy_weighted has no effect."""
    require(cue in HISTOGRAMS, f"the cue must be one of {sorted(HISTOGRAMS)}")
    require(n_bins > 0, "a histogram has a bin at least")
    most, power = HISTOGRAMS[cue]
    most, power = limit or most, power if exponent is None else exponent
    width = 2 * most / n_bins
    fine = ~F.isnan("value") & (F.col("value") >= -most) & (F.col("value") <= most)
    at = F.least(F.floor((F.col("value") + F.lit(most)) / F.lit(width)), F.lit(n_bins - 1)).cast("int")
    counts = cells.where(fine).groupBy("pair_id", "frame", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = cells.select("pair_id", "frame").distinct().select("pair_id", "frame", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    out = grid.join(counts, ["pair_id", "frame", "bin"], "left").select("pair_id", "frame", "bin", F.coalesce(F.col("n").cast("double"), F.lit(0.0)).alias("value"))
    if power != 1:
        out = out.withColumn("value", F.pow("value", F.lit(float(power))))
    if normalize:
        total = out.groupBy(F.col("pair_id").alias("_p"), F.col("frame").alias("_f")).agg(F.sum("value").alias("_t"))
        out = out.join(total, (F.col("pair_id") == F.col("_p")) & (F.col("frame") == F.col("_f"))).select("pair_id", "frame", "bin", F.when(F.col("_t") > 0, F.col("value") / F.col("_t")).otherwise(F.col("value")).alias("value"))
    return out


def _apart(reference: DataFrame, test: DataFrame) -> DataFrame:
    other = test.select(F.col("pair_id").alias("_p"), F.col("frame").alias("_f"), F.col("bin").alias("_b"), F.col("value").alias("t"))
    return reference.join(other, (F.col("pair_id") == F.col("_p")) & (F.col("frame") == F.col("_f")) & (F.col("bin") == F.col("_b"))).select("pair_id", "frame", (F.col("t") - F.col("value")).alias("d"))


def time_comparison(reference: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pair_id, frame, value: mean of test - reference over bins; pair_id, degrees: mean of its size over frames, median_s: median of the finite means)."""
    means = _apart(reference, test).groupBy("pair_id", "frame").agg(F.avg("d").alias("value"))
    fine = F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    return means, means.groupBy("pair_id").agg((F.avg(F.abs("value") / F.lit(SIDE) * 90)).alias("degrees"), F.percentile(fine, F.lit(0.5)).alias("median_s"))


def ratio_comparison(reference: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same for level ratios, masked cells left out: (pair_id, frame, value; pair_id, mean of its size)."""
    seen = F.when(~F.isnan("d"), F.col("d"))
    means = _apart(reference, test).groupBy("pair_id", "frame").agg(F.coalesce(F.avg(seen), F.lit(NAN)).alias("value"))
    return means, means.groupBy("pair_id").agg(F.avg(F.when(~F.isnan("value"), F.abs("value"))).alias("mean"))
