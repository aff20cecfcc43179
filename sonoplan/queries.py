"""Queries over the driver's tables, one for each operator, by name.

Signals: the embeddings (64 samples), the hourly value of each type of event (720 samples), pairs of embeddings (stereo) and
embeddings as images of 8 by 8. Results are rounded so that two engines' last digits do not matter.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.windows import Window
from .operators import binaural as bi
from .operators import convolution as conv
from .operators import features, fourier, image, lapped, spectro
from .operators import filterbanks as fb
from .params import BinauralParams, ChromaParams, CqtParams, ErbParams, LogHzParams, LogParams, MdctParams, MelParams, MfccParams, SpectroParams, StftParams
from .plans import spatial, vector
from .plans.planner import Planner
from .sources import signals as src
from .streaming import frames as stream_frames
from .streaming import tables as stream_tables

Query = Callable[[SparkSession, str], DataFrame]

RATE = 16000.0
STFT = StftParams(64, 32)
P = SpectroParams(STFT, RATE)
WHOLE = SpectroParams(StftParams(64, 64, centre=False), RATE)
MEL = {n: MelParams(12, 0.0, 8000.0, n) for n in ("none", "slaney", "l1", "l2")}
LOGHZ = LogHzParams(12, 250.0, 8000.0)
ERB = ErbParams(8, 100.0, 8000.0)
TR35 = ErbParams(8, 100.0, 8000.0, "apple_tr35")
CQT = CqtParams(6, 3, 500.0)
DB = LogParams(-80.0)
MFCC = MfccParams(6)
MDCT = MdctParams.sine(64)
BAND = BinauralParams(WHOLE, 500.0, 7500.0)
FRAMES = STFT.frame_count(src.HOURS)
#: A short response: five taps.
RESPONSE = (0.5, 0.25, -0.125, 0.0625, 0.3125)
WINDOW_SIZE = 33


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded, without negative zeros."""
    return df.select(*((F.round(F.col(n), digits) + F.lit(0.0)).alias(n) if t in ("double", "float") else F.col(n) for n, t in df.dtypes))


def _hours(spark: SparkSession, sf: str) -> DataFrame:
    return src.hourly(spark, sf)


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return src.to_long(src.vectors(spark, sf))


def _packed_hours(spark: SparkSession, sf: str) -> DataFrame:
    return src.to_packed(_hours(spark, sf))


def _nan_to_null(df: DataFrame, c: str = "value") -> DataFrame:
    return df.withColumn(c, F.when(~F.isnan(c), F.col(c)))


def _response(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(map(float, RESPONSE))), "tap int, h double")


def _window(w: Window) -> Query:
    return lambda spark, sf: _rounded(w.table(spark, WINDOW_SIZE).withColumnRenamed("w", "value"), 9)


def _custom(norm: str) -> Query:
    w = Window.custom([1 + k % 7 for k in range(WINDOW_SIZE)], norm)
    return _window(w)


def _frame_count(spark: SparkSession, sf: str) -> DataFrame:
    lengths = _hours(spark, sf).groupBy("signal_id").agg((F.max("n") + 1).alias("length"))
    return spectro.output_shape(lengths, P, STFT.n_bins).select("signal_id", "n_frames")


def _spectro(kind: str, scale: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        long = _hours(spark, sf)
        own = {
            "linear": lambda: spectro.linear(long, P, scale, DB, src.HOURS),
            "mel": lambda: spectro.mel(long, P, MEL["none"], scale, DB, src.HOURS),
            "loghz": lambda: spectro.log_hz(long, P, LOGHZ, scale, DB, src.HOURS),
            "erb": lambda: spectro.erb(long, P, ERB, scale, DB, src.HOURS),
            "cqt": lambda: spectro.cqt(long, P, CQT, scale, DB, src.HOURS),
        }[kind]()
        return _rounded(own, 4 if scale == "power" else 5)

    return run


def _fast(kind: str, scale: str) -> Query:
    bands = {"linear": None, "mel": MEL["none"], "log_hz": LOGHZ, "erb": ERB, "cqt": CQT}[kind]

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _rounded(Planner().plan(kind, scale, P, bands, DB).long(_packed_hours(spark, sf)), 4 if scale == "power" else 5)

    return run


def _table(weights: Callable[[], np.ndarray]) -> Query:
    return lambda spark, sf: _rounded(fb.weight_table(spark, weights()).withColumnRenamed("w", "value"), 9)


def _axis(values: Callable[[], np.ndarray]) -> Query:
    return lambda spark, sf: _rounded(fb.axis_table(spark, values()).withColumnRenamed("freq_hz", "value"), 6)


def _cqt_kernel(spark: SparkSession, sf: str) -> DataFrame:
    kernels = fb.cqt_kernels(RATE, CQT, STFT.n_fft)
    rows = [(k, n, float(z.real), float(z.imag)) for k, own in enumerate(kernels) for n, z in enumerate(own)]
    return _rounded(spark.createDataFrame(rows, "bin int, n int, re double, im double"), 9)


def _chroma(norm: str) -> Query:
    return lambda spark, sf: _rounded(features.chroma(_hours(spark, sf), P, ChromaParams(norm=norm), src.HOURS), 6)


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return src.vector_pairs(spark, sf)


def _itd(spark: SparkSession, sf: str) -> DataFrame:
    return bi.time_difference(_pairs(spark, sf), BAND, 64)


def _ipd(wrapped: bool) -> Query:
    return lambda spark, sf: bi.phase_difference(_pairs(spark, sf), BinauralParams(WHOLE, 500.0, 7500.0, wrapped=wrapped), 64)


def _ild(spark: SparkSession, sf: str) -> DataFrame:
    return bi.level_difference(_pairs(spark, sf), BAND, 64)


def _ilr(spark: SparkSession, sf: str) -> DataFrame:
    return bi.level_ratio(_pairs(spark, sf), BAND, 64)


def _cue(cells: Query, digits: int = 6) -> Query:
    return lambda spark, sf: _rounded(_nan_to_null(cells(spark, sf)), digits)


def _histogram(cells: Query, cue: str, normalize: bool) -> Query:
    # Values are rounded first, so that one at a bin's edge falls to the same side everywhere.
    return lambda spark, sf: _rounded(bi.histogram(_rounded(cells(spark, sf), 9), cue, 20, normalize=normalize), 9)


def _swapped(spark: SparkSession, sf: str) -> DataFrame:
    """The pairs with their sides exchanged: what the comparisons compare with."""
    return _pairs(spark, sf).select("pair_id", "n", F.col("right").alias("left"), F.col("left").alias("right"))


def _magphase(spark: SparkSession, sf: str) -> DataFrame:
    z = fourier.fft(_vectors(spark, sf), 64)
    m, c, s = bi.magphase(F.col("re"), F.col("im"), 1.5)
    return _rounded(z.select("signal_id", "bin", m.alias("magnitude"), c.alias("phase_re"), s.alias("phase_im")))


def _images(spark: SparkSession, sf: str) -> DataFrame:
    return src.vector_images(spark, sf)


def _image(f: Callable[[DataFrame], DataFrame], digits: int = 6) -> Query:
    return lambda spark, sf: _rounded(f(_images(spark, sf)), digits)


def _convolve_2d(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(image.convolve(_images(spark, sf), image.gaussian_kernel(spark, 3, 1.0), 8, 8, 3, 3))


def _day_hour(spark: SparkSession, sf: str) -> DataFrame:
    """Images of 24 rows and 30 columns: hours by days."""
    return _hours(spark, sf).select(F.col("signal_id").alias("image_id"), (F.col("n") % 24).cast("int").alias("r"), F.floor(F.col("n") / 24).cast("int").alias("c"), F.col("x").alias("v"))


def _vector_list(f: Callable[[np.ndarray], np.ndarray], digits: int = 6) -> Query:
    """signal_id, i, value of a vectorised function of each embedding."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        own = src.vectors(spark, sf).select("signal_id", F.posexplode(vector.list_udf(f, F.col("samples"))).alias("i", "value"))
        return _rounded(own, digits)

    return run


def _deconvolve(spark: SparkSession, sf: str) -> DataFrame:
    long = _vectors(spark, sf)
    ids = long.select("signal_id").distinct()
    low = ids.join(F.broadcast(_response(spark))).select("signal_id", F.col("tap").cast("long").alias("n"), F.col("h").alias("x"))  # five taps each
    return _rounded(conv.deconvolve(long, low, 64, len(RESPONSE), 0.01))


def _axes(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(spectro.with_axes(spectro.linear(_hours(spark, sf), P, "magnitude", None, src.HOURS), P, fb.bin_frequencies(P)), 5)


def _batch(spark: SparkSession, sf: str) -> DataFrame:
    """Spectra of signals of two lengths, the embeddings and the hourly series, in one rectangular batch."""
    named = _vectors(spark, sf).withColumn("signal_id", F.concat(F.lit("v"), F.col("signal_id").cast("string")))
    p = StftParams(16, 8, centre=False)
    own = fourier.stft(named.unionByName(_hours(spark, sf)), p).select("signal_id", "frame", "bin", fourier.power().alias("value"))
    return _rounded(src.pad_to_longest(own), 4)


def _packed_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.pack_pairs(src.vectors(spark, sf), F.floor(F.col("signal_id") / 2).cast("long"), F.pmod(F.col("signal_id"), F.lit(2)))


def _cue_fast(cue: str, wrapped: bool = False, digits: int = 6) -> Query:
    p = BinauralParams(WHOLE, 500.0, 7500.0, wrapped=wrapped)
    return lambda spark, sf: _rounded(_nan_to_null(spatial.BinauralPlan(p, cue).long(_packed_pairs(spark, sf))), digits)


def _packed_images(spark: SparkSession, sf: str) -> DataFrame:
    return src.vectors(spark, sf).select(F.col("signal_id").alias("image_id"), F.col("samples").alias("pixels"))


def _image_fast(f: Callable[[spatial.ImagePlan, DataFrame], DataFrame], half: bool = False, names: dict | None = None) -> Query:
    plan = spatial.ImagePlan(8, 8)
    return lambda spark, sf: _rounded(plan.long(f(plan, _packed_images(spark, sf)), half, names))


def _day_hour_fast(f: Callable[[spatial.ImagePlan, DataFrame], DataFrame], half: bool = False, names: dict | None = None) -> Query:
    plan = spatial.ImagePlan(24, 30)
    return lambda spark, sf: _rounded(plan.long(f(plan, spatial.pack_images(_day_hour(spark, sf), 24, 30)), half, names), 7)


def _deconvolve_fast(spark: SparkSession, sf: str) -> DataFrame:
    from .api import compute_deconvolution

    pairs = src.vectors(spark, sf).select("signal_id", F.col("samples").alias("numerator"), F.array(*map(F.lit, RESPONSE)).alias("denominator"))
    out = compute_deconvolution(pairs, 0.01).select("signal_id", F.posexplode("samples").alias("n", "x"))
    return _rounded(out.select("signal_id", F.col("n").cast("long").alias("n"), "x"))


def _c2c(inverse: bool) -> Query:
    """Pairs of embeddings as complex signals."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        z = spatial.c2c(_packed_pairs(spark, sf).select(F.col("pair_id").alias("signal_id"), F.col("left").alias("re"), F.col("right").alias("im")), inverse)
        rows = z.select("signal_id", F.posexplode(F.arrays_zip("re", "im")).alias("bin", "z"))
        return _rounded(rows.select("signal_id", "bin", "z.re", "z.im"))

    return run


def _odd(inverse: bool) -> Query:
    """The 33 bins of each embedding's spectrum, rotated."""
    return lambda spark, sf: _rounded(fourier.fftshift_1d(fourier.power_spectrum(_vectors(spark, sf), 64).select("signal_id", F.col("bin").cast("long").alias("n"), F.col("value").alias("x")), 33, inverse))


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    """The embeddings as a stream of samples."""
    rows = stream_tables.read_stream(spark, f"{sf}/embeddings.parquet")
    return rows.select(F.col("vec_id").alias("signal_id"), F.posexplode("embedding").alias("n", "x")).select("signal_id", F.col("n").cast("long").alias("n"), F.col("x").cast("double").alias("x"))


def _stream_spectra(spark: SparkSession, sf: str) -> DataFrame:
    own = stream_tables.run(stream_frames.spectra_stream(_stream(spark, sf), StftParams(16, 8, centre=False)))
    return _rounded(own.select("signal_id", "frame", F.posexplode("power").alias("bin", "value")))


def _stream_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(stream_tables.run(stream_frames.filter_stream(_stream(spark, sf), RESPONSE)))


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {}
    q["frame_count"] = _frame_count
    for name, w in (("rect", Window.rectangular()), ("hann", Window.hanning()), ("hamming", Window.hamming()), ("blackman", Window.blackman()), ("kaiser", Window.kaiser(5.0)), ("gaussian", Window.gaussian(6.0))):
        q[f"window_{name}"] = _window(w)
    for norm in ("sum", "peak", "energy"):
        q[f"window_custom_norm_{norm}"] = _custom(norm)
    q["frames_windowed"] = lambda s, d: _rounded(fourier.frames(_hours(s, d), STFT, True, src.HOURS), 6)
    q["frames_uncentred"] = lambda s, d: _rounded(fourier.frames(_hours(s, d), STFT.with_(centre=False), True), 6)
    q["fft_complex"] = lambda s, d: _rounded(fourier.fft(_vectors(s, d), 64))
    q["fft_zero_padded"] = lambda s, d: _rounded(fourier.fft(_vectors(s, d), 96))
    q["rfft_magnitude"] = lambda s, d: _rounded(fourier.rfft(_vectors(s, d), 64))
    q["power_spectrum"] = lambda s, d: _rounded(fourier.power_spectrum(_vectors(s, d), 64, Window.hanning()))
    q["magnitude_spectrum"] = lambda s, d: _rounded(fourier.magnitude_spectrum(_vectors(s, d), 64, Window.hamming()))
    q["irfft_roundtrip"] = lambda s, d: _rounded(fourier.irfft(fourier.fft(_vectors(s, d), 64), 64))
    q["stft_complex"] = lambda s, d: _rounded(fourier.stft(_hours(s, d), STFT, src.HOURS), 5)
    q["istft_reconstruct"] = lambda s, d: _rounded(fourier.istft(fourier.stft(_hours(s, d), STFT, src.HOURS), STFT))
    for kind in ("linear", "mel", "loghz", "erb", "cqt"):
        for scale in spectro.AMPLITUDES:
            q[f"{kind}_{scale}"] = _spectro(kind, scale)
            q[f"{kind}_{scale}_fast"] = _fast({"loghz": "log_hz"}.get(kind, kind), scale)
    for norm in MEL:
        q[f"mel_filterbank_{norm}"] = _table(lambda n=norm: fb.mel_weights(P, MEL[n]))
    q["loghz_filterbank"] = _table(lambda: fb.log_hz_weights(P, LOGHZ))
    q["erb_filterbank"] = _table(lambda: fb.erb_weights(P, ERB))
    q["chroma_filterbank"] = _table(lambda: fb.chroma_weights(P, ChromaParams()))
    q["mel_axis"] = _axis(lambda: fb.mel_axis(P, MEL["none"]))
    q["erb_linear_centres"] = _axis(lambda: fb.erb_axis(ERB))
    q["erb_tr35_centres"] = _axis(lambda: fb.erb_axis(TR35))
    q["cqt_kernel"] = _cqt_kernel
    q["cqt_complex"] = lambda s, d: _rounded(spectro.cqt_complex(_hours(s, d), P, CQT, src.HOURS))
    q["linear_axes"] = _axes
    q["db_range"] = lambda s, d: _rounded(spectro.db_range(spectro.linear_power(_hours(s, d), P, src.HOURS)), 5)
    q["statistics"] = lambda s, d: _rounded(spectro.statistics(spectro.linear(_hours(s, d), P, "magnitude", None, src.HOURS)), 5)
    q["duration"] = lambda s, d: _rounded(spectro.duration(spectro.linear_power(_hours(s, d), P, src.HOURS), P), 9)
    q["one_frame"] = lambda s, d: _rounded(spectro.linear(_hours(s, d), P, "power", None, src.HOURS).where("frame = 3"), 4)
    q["batch_padded"] = _batch
    q["mfcc"] = lambda s, d: _rounded(features.mfcc(_hours(s, d), P, 12, MFCC, src.HOURS), 5)
    q["mfcc_no_c0"] = lambda s, d: _rounded(features.mfcc(_hours(s, d), P, 12, MfccParams(6, False, 22), src.HOURS), 5)
    for norm in ("none", "l1", "l2", "max"):
        q[f"chroma_{norm}"] = _chroma(norm)
    q["peak_frequency"] = lambda s, d: _rounded(features.peaks(spectro.linear(_hours(s, d), P, "power", None, src.HOURS), fb.bin_frequencies(P)), 4)
    q["stmtf"] = lambda s, d: _rounded(features.modulation(_hours(s, d), P, MelParams(8, 0.0, 8000.0), FRAMES, src.HOURS), 3)
    q["mdct"] = lambda s, d: _rounded(lapped.mdct(_hours(s, d), MDCT, src.HOURS))
    q["imdct_reconstruct"] = lambda s, d: _rounded(lapped.imdct(lapped.mdct(_hours(s, d), MDCT, src.HOURS), MDCT, 700))
    q["convolve_1d"] = lambda s, d: _rounded(conv.convolve(_vectors(s, d), _response(s), len(RESPONSE)))
    q["overlap_save_batch"] = lambda s, d: _rounded(conv.filter_blocks(_hours(s, d), _response(s), len(RESPONSE)), 9)
    q["deconvolve_1d"] = _deconvolve
    q["magphase"] = _magphase
    q["itd"] = _cue(_itd, 9)
    q["ipd"] = _cue(_ipd(False))
    q["ipd_wrapped"] = _cue(_ipd(True))
    q["ild"] = _cue(_ild)
    q["ilr"] = _cue(_ilr)
    for cue, name, cells in (("time", "itd", _itd), ("phase", "ipd", _ipd(True)), ("level", "ild", _ild), ("ratio", "ilr", _ilr)):
        q[f"{name}_histogram"] = _histogram(cells, cue, False)
        q[f"{name}_histogram_normalized"] = _histogram(cells, cue, True)
    q["itd_diff"] = lambda s, d: _rounded(bi.time_comparison(_itd(s, d), bi.time_difference(_swapped(s, d), BAND, 64))[0], 9)
    q["itd_diff_summary"] = lambda s, d: _rounded(bi.time_comparison(_itd(s, d), bi.time_difference(_swapped(s, d), BAND, 64))[1], 6)
    q["ilr_diff"] = lambda s, d: _rounded(bi.ratio_comparison(_ilr(s, d), bi.level_ratio(_swapped(s, d), BAND, 64))[1])
    q["fft2d"] = _image(lambda i: image.fft2d(i, 8, 8))
    q["fft2d_rectangular"] = lambda s, d: _rounded(image.fft2d(_day_hour(s, d), 24, 30), 7)
    q["power_2d"] = _image(lambda i: image.power_2d(i, 8, 8))
    q["magnitude_2d"] = _image(lambda i: image.magnitude_2d(i, 8, 8))
    q["ifft2d_roundtrip"] = _image(lambda i: image.ifft2d(image.fft2d(i, 8, 8), 8, 8))
    # Images of 8 rows and 8 columns, their spectra of 8 rows and 5 columns; signals of 64 samples, their spectra of 33 bins.
    q["fftshift_2d"] = _image(lambda i: image.shift_2d(i, 8, 8))
    q["ifftshift_2d"] = _image(lambda i: image.shift_2d(i, 8, 8, True))
    q["fftshift_2d_odd"] = _image(lambda i: image.shift_2d(image.magnitude_2d(i, 8, 8), 8, 5))
    q["ifftshift_2d_odd"] = _image(lambda i: image.shift_2d(image.magnitude_2d(i, 8, 8), 8, 5, True))
    q["fftshift_1d"] = lambda s, d: _rounded(fourier.fftshift_1d(_vectors(s, d), 64))
    q["ifftshift_1d"] = lambda s, d: _rounded(fourier.fftshift_1d(_vectors(s, d), 64, True))
    q["fftshift_1d_odd"], q["ifftshift_1d_odd"] = _odd(False), _odd(True)
    q["fftfreq"] = lambda s, d: _rounded(fourier.fft_frequencies(s, 15, 0.1), 9)
    q["rfftfreq"] = lambda s, d: _rounded(fourier.rfft_frequencies(s, 15, 0.1), 9)
    q["gaussian_kernel"] = lambda s, d: _rounded(image.gaussian_kernel(s, 5, 1.2), 9)
    q["convolve_2d"] = _convolve_2d
    q["lowpass"] = _image(lambda i: image.lowpass(i, 8, 8, 0.8))
    q["highpass"] = _image(lambda i: image.highpass(i, 8, 8, 0.5))
    q["bandpass"] = _image(lambda i: image.bandpass(i, 8, 8, 0.4, 1.0))
    q["edges"] = lambda s, d: _rounded(image.edges(_day_hour(s, d), 24, 30), 7)
    q["sharpen"] = lambda s, d: _rounded(image.sharpen(_day_hour(s, d), 24, 30, 1.5), 7)
    # Vectorised only: recurrences and transforms of many steps.
    q["gammatone_iir"] = _vector_list(lambda x: vector.gammatone(x, RATE, 32, 16, ERB).ravel(), 8)
    q["minimum_phase"] = _vector_list(lambda x: vector.minimum_phase(x))
    q["cqt_free"] = _vector_list(lambda x: np.abs(vector.cqt_free(x, RATE, CQT, 64)).ravel())
    q["fft_convolve_fast"] = _vector_list(lambda x: vector.fft_convolve(x, np.array(RESPONSE)))
    q["mdct_fast"] = _vector_list(lambda x: vector.mdct(x, MdctParams.sine(32)).ravel())
    q["convolve_2d_fast"] = _vector_list(lambda x: vector.convolve_2d(x.reshape(8, 8), np.outer([1, 2, 1], [1, 2, 1]) / 16.0).ravel())
    q["lowpass_fast"] = _vector_list(lambda x: vector.filter_2d(x.reshape(8, 8), vector.lowpass_mask(8, 8, 0.8)).ravel())
    q["itd_fast"], q["ipd_fast"], q["ipd_wrapped_fast"] = _cue_fast("itd", digits=9), _cue_fast("ipd"), _cue_fast("ipd", True)
    q["ild_fast"], q["ilr_fast"] = _cue_fast("ild"), _cue_fast("ilr")
    both = {"re": "re", "im": "im"}
    q["fft2d_fast"] = _image_fast(lambda p, i: p.fft2d(i), True, both)
    q["fft2d_rectangular_fast"] = _day_hour_fast(lambda p, i: p.fft2d(i), True, both)
    q["power_2d_fast"] = _image_fast(lambda p, i: p.power(i), True)
    q["magnitude_2d_fast"] = _image_fast(lambda p, i: p.magnitude(i), True)
    q["ifft2d_roundtrip_fast"] = _image_fast(lambda p, i: p.ifft2d(p.fft2d(i)))
    q["highpass_fast"] = _image_fast(lambda p, i: p.highpass(i, 0.5))
    q["bandpass_fast"] = _image_fast(lambda p, i: p.bandpass(i, 0.4, 1.0))
    q["convolve_2d_gaussian_fast"] = _image_fast(lambda p, i: p.convolve(i, spatial.gaussian_kernel(3, 1.0)))
    q["fftshift_2d_fast"] = _image_fast(lambda p, i: p.shifted(i))
    q["edges_fast"] = _day_hour_fast(lambda p, i: p.edges(i))
    q["sharpen_fast"] = _day_hour_fast(lambda p, i: p.sharpen(i, 1.5))
    q["deconvolve_1d_fast"] = _deconvolve_fast
    q["stmtf_fast"] = lambda s, d: _rounded(spatial.ModulationPlan(P, MelParams(8, 0.0, 8000.0)).long(_packed_hours(s, d)), 3)
    q["fft_c2c"], q["ifft_c2c"] = _c2c(False), _c2c(True)
    q["stream_spectra"] = _stream_spectra
    q["stream_filter"] = _stream_filter
    return q
