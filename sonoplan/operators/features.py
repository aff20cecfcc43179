"""Features derived from spectra: cepstral coefficients, pitch classes, peaks, modulation spectra."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import require
from ..params import ChromaParams, LogParams, MelParams, MfccParams, SpectroParams
from . import filterbanks as fb
from .image import fft2d, shift_2d
from .spectro import linear_power, mel


def mfcc_from_log_mel(log_mel: DataFrame, n_mels: int, m: MfccParams) -> DataFrame:
    """signal_id, frame, bin (the coefficient), value of mel bands in dB."""
    require(m.n_mfcc <= n_mels, "there are no more coefficients than bands")
    out = fb.apply_weights(log_mel, fb.dct_weights(m.n_mfcc, n_mels))
    if m.lifter:
        out = out.withColumn("value", F.col("value") * (1 + F.lit(m.lifter / 2) * F.sin(F.lit(math.pi / m.lifter) * F.col("bin"))))
    return out if m.include_c0 or m.n_mfcc == 1 else out.where("bin > 0").withColumn("bin", F.col("bin") - 1)


def mfcc(long: DataFrame, p: SpectroParams, n_mels: int, m: MfccParams, length: int | None = None) -> DataFrame:
    """Bands from 0 to Nyquist in dB above -80."""
    return mfcc_from_log_mel(mel(long, p, MelParams(n_mels, 0.0, p.nyquist), "db", LogParams(-80.0), length), n_mels, m)


def chroma_from_magnitude(magnitude: DataFrame, p: SpectroParams, c: ChromaParams) -> DataFrame:
    """signal_id, frame, bin (the pitch class), value, normalised within each frame where its norm is not 0."""
    out = fb.apply_weights(magnitude, fb.chroma_weights(p, c))
    if c.norm == "none":
        return out
    frame = Window.partitionBy("signal_id", "frame")
    size = {"l1": F.sum("value").over(frame), "l2": F.sqrt(F.sum(F.col("value") * F.col("value")).over(frame)), "max": F.max("value").over(frame)}[c.norm]
    return out.withColumn("_s", size).withColumn("value", F.when(F.col("_s") > 0, F.col("value") / F.col("_s")).otherwise(F.col("value"))).drop("_s")


def chroma(long: DataFrame, p: SpectroParams, c: ChromaParams, length: int | None = None) -> DataFrame:
    magnitude = linear_power(long, p, length).withColumn("value", F.sqrt("value"))
    return chroma_from_magnitude(magnitude, p, c)


def peaks(spectra: DataFrame, frequencies: np.ndarray | None = None) -> DataFrame:
    """signal_id, frame, bin, value of each frame's largest value; ties go to the lowest bin."""
    best = F.max(F.struct(F.col("value"), (-F.col("bin")).alias("b")))
    out = spectra.groupBy("signal_id", "frame").agg(best.alias("_m")).select("signal_id", "frame", (-F.col("_m.b")).alias("bin"), F.col("_m.value").alias("value"))
    if frequencies is None:
        return out
    axis = fb.axis_table(spectra.sparkSession, frequencies).withColumnRenamed("bin", "_b")
    return out.join(F.broadcast(axis), F.col("bin") == F.col("_b")).drop("_b")


def modulation(long: DataFrame, p: SpectroParams, m: MelParams, n_frames: int, length: int | None = None) -> DataFrame:
    """image_id, r, c, v: magnitudes of the two-dimensional spectrum of mel powers, zero frequencies in the middle rows."""
    image = mel(long, p, m, "power", None, length).select(F.col("signal_id").alias("image_id"), F.col("bin").alias("r"), F.col("frame").alias("c"), F.col("value").alias("v"))
    spectrum = fft2d(image, m.n_mels, n_frames).select("image_id", "r", "c", F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("v"))
    return shift_2d(spectrum, m.n_mels, n_frames // 2 + 1)
