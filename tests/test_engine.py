import numpy as np
import pytest
from pyspark.sql import functions as F

from sonoplan.errors import DimensionMismatch, InvalidInput
from sonoplan.functions.windows import Window
from sonoplan.operators import binaural, convolution, features, fourier, image, lapped, spectro
from sonoplan.operators import filterbanks as fb
from sonoplan.params import BinauralParams, ChromaParams, CqtParams, ErbParams, LogHzParams, LogParams, MdctParams, MelParams, MfccParams, SpectroParams, StftParams
from sonoplan.plans import vector
from sonoplan.plans.planner import ChromaPlan, MfccPlan, Planner
from sonoplan.sources import signals as src
from sonoplan.sources import sinks, transformers

RATE = 16000.0
P = SpectroParams(StftParams(32, 16), RATE)
RNG = np.random.default_rng(0)
X = {0: RNG.standard_normal(100), 1: RNG.standard_normal(20), 2: np.sin(np.arange(64) * 0.3)}


@pytest.fixture(scope="module")
def packed(spark):
    return spark.createDataFrame([(k, v.tolist()) for k, v in X.items()], "signal_id long, samples array<double>")


@pytest.fixture(scope="module")
def long(packed):
    return src.to_long(packed)


def matrix(df, key, c1="frame", c2="bin", value="value"):
    rows = df.where(F.col("signal_id") == key).toPandas()
    out = np.zeros((rows[c1].max() + 1, rows[c2].max() + 1))
    out[rows[c1], rows[c2]] = rows[value]
    return out


def slow_frames(x, p, windowed=True):
    padded = np.concatenate((np.zeros(p.pad), x, np.zeros(p.pad + p.n_fft)))
    w = p.window.values(p.n_fft) if windowed else 1
    return np.array([padded[k * p.hop : k * p.hop + p.n_fft] * w for k in range(p.frame_count(len(x)))])


def slow_power(x, p):
    k, i = np.arange(p.n_bins)[:, None], np.arange(p.n_fft)[None, :]
    return np.abs(slow_frames(x, p) @ np.exp(-2j * np.pi * k * i / p.n_fft).T) ** 2


@pytest.mark.parametrize("centre", [True, False])
def test_relational_and_vectorised_power_equal_the_definition(long, packed, centre):
    p = SpectroParams(StftParams(32, 16, centre=centre), RATE)
    a, b = spectro.linear(long, p), Planner().linear_power(p).long(packed)
    for k, x in X.items():
        want = slow_power(x, p.stft)
        assert np.allclose(matrix(a, k), want, atol=1e-9)
        assert np.allclose(matrix(b, k), want, atol=1e-9)


@pytest.mark.parametrize(("kind", "bands"), [("mel", MelParams(6, 0.0, 8000.0, "l2")), ("log_hz", LogHzParams(6, 600.0, 8000.0)), ("erb", ErbParams(5, 200.0, 7000.0)), ("cqt", CqtParams(4, 2, 900.0))])
@pytest.mark.parametrize("scale", ["power", "magnitude", "db"])
def test_relational_equals_vectorised(long, packed, kind, bands, scale):
    run = {"mel": spectro.mel, "log_hz": spectro.log_hz, "erb": spectro.erb, "cqt": spectro.cqt}[kind]
    a = run(long, P, bands, scale, LogParams(-60.0))
    b = Planner().plan(kind, scale, P, bands, LogParams(-60.0)).long(packed)
    for k in X:
        assert np.allclose(matrix(a, k), matrix(b, k), atol=1e-8)


def test_db_without_floor_is_power_and_range(long):
    db = spectro.linear(long, P, "db")
    assert np.allclose(matrix(db, 0), matrix(spectro.linear(long, P), 0))
    floor = spectro.linear(long, P, "db", LogParams(-20.0)).agg(F.min("value")).first()[0]
    assert floor >= -20.0


def test_single_frame_shape_and_float(packed):
    plan = Planner().mel_power(P, MelParams(6, 0.0, 8000.0))
    whole = plan.matrix(X[0])
    one = {r.signal_id: r.bands for r in plan.compute_frame(packed, 3).collect()}
    assert np.allclose(one[0], whole[3]) and np.allclose(one[1], 0 if P.stft.frame_count(20) <= 3 else plan.matrix(X[1])[3])
    assert plan.output_shape(100) == (6, P.stft.frame_count(100))
    f32 = plan.compute(packed.withColumn("samples", F.col("samples").cast("array<float>")), "float").where("signal_id = 0").first().frames
    assert np.allclose(np.array(f32), whole, rtol=1e-4, atol=1e-4)


def test_inverse_transforms(long):
    back = fourier.irfft(fourier.fft(long.where("signal_id = 2"), 64), 64).sort("n").toPandas()["x"]
    assert np.allclose(back, X[2], atol=1e-10)
    p = StftParams(16, 4)
    x = fourier.istft(fourier.stft(long.where("signal_id = 0"), p), p).sort("n").toPandas()
    assert np.allclose(x["x"].to_numpy()[:96], X[0][:96], atol=1e-9)
    assert np.allclose(vector.istft(np.fft.rfft(vector.framed(X[0], p), axis=1), p), x["x"], atol=1e-9)


def test_parseval_and_linearity(long):
    rows = fourier.power_spectrum(long.where("signal_id = 2"), 64).toPandas()
    weight = np.where(rows["bin"].isin([0, 32]), 1, 2)
    assert abs((rows["value"] * weight).sum() / 64 - (X[2] ** 2).sum()) < 1e-6


def test_too_long_and_empty_signals_are_errors(spark, long):
    with pytest.raises(Exception, match="longer than n_fft"):
        fourier.fft(long, 32).count()
    with pytest.raises(Exception, match="empty"):
        src.to_long(spark.createDataFrame([(0, [])], "signal_id long, samples array<double>")).count()
    with pytest.raises(DimensionMismatch):
        vector.spectrum(np.zeros(9), 8)
    with pytest.raises(InvalidInput):
        fourier.basis(spark, 4096)
    with pytest.raises(InvalidInput):
        spectro.mel(long, P, MelParams(4, 0.0, 9000.0))


def test_tone_peaks_where_it_should(spark):
    x = np.sin(2 * np.pi * 440 * np.arange(16000) / RATE)
    p = SpectroParams(StftParams(2048, 512), RATE)
    assert np.argmax(ChromaPlan(p, ChromaParams()).matrix(x).mean(axis=0)) == 9
    c4 = np.sin(2 * np.pi * 261.63 * np.arange(16000) / RATE)
    assert np.argmax(ChromaPlan(p, ChromaParams()).matrix(c4).mean(axis=0)) == 0
    cqt = np.abs(vector.cqt_free(x, RATE, CqtParams(12, 5, 110.0), 4096)).mean(axis=0)
    peak = CqtParams(12, 5, 110.0).frequency(int(np.argmax(cqt)))
    assert abs(peak - 440) / 440 < 0.05


@pytest.mark.parametrize("norm", ["l1", "l2", "max"])
def test_chroma_norms(long, packed, norm):
    p = SpectroParams(StftParams(64, 32), RATE)
    rows = matrix(features.chroma(long, p, ChromaParams(f_min=200.0, norm=norm)), 0)
    measure = {"l1": lambda v: v.sum(), "l2": lambda v: np.sqrt((v * v).sum()), "max": np.max}[norm]
    assert all(abs(measure(r) - 1) < 1e-6 for r in rows)
    assert np.allclose(rows, ChromaPlan(p, ChromaParams(f_min=200.0, norm=norm)).matrix(X[0]))


def test_mfcc(long):
    for m in (MfccParams(5), MfccParams(5, False), MfccParams(5, True, 0)):
        rows = matrix(features.mfcc(long, P, 8, m), 0)
        assert np.allclose(rows, MfccPlan(P, 8, m).matrix(X[0]), atol=1e-8)
        assert rows.shape[1] == (5 if m.include_c0 else 4)
    with pytest.raises(InvalidInput):
        features.mfcc(long, P, 4, MfccParams(5))


def test_filterbanks():
    w = fb.mel_weights(P, MelParams(4, 0.0, 8000.0, "l1"))
    assert np.allclose(w.sum(axis=1), 1)
    assert ((fb.mel_weights(P, MelParams(40, 0.0, 8000.0)) > 0).sum(axis=0) <= 2).all()
    assert np.allclose(fb.mel_to_hz(fb.hz_to_mel([0, 440, 1000, 4000])), [0, 440, 1000, 4000])
    assert fb.erb_axis(ErbParams(5, 100, 4000, "apple_tr35"))[0] == pytest.approx(100)
    assert np.allclose(fb.chroma_weights(P, ChromaParams()).sum(axis=1), 1)


def test_mdct(long):
    p = MdctParams.sine(16)
    got = matrix(lapped.mdct(long.where("signal_id = 0"), p), 0, "frame", "k")
    k, n = np.arange(8)[:, None], np.arange(16)[None, :]
    basis = np.cos(np.pi / 8 * (n + 0.5 + 4) * (k + 0.5))
    frames = np.array([X[0][a : a + 16] for a in range(0, 100 - 16 + 1, 8)]) * p.window.values(16)
    assert np.allclose(got, frames @ basis.T, atol=1e-10) and np.allclose(vector.mdct(X[0], p), got, atol=1e-10)
    back = lapped.imdct(lapped.mdct(long.where("signal_id = 0"), p), p, 90).sort("n").toPandas()["x"].to_numpy()
    assert len(back) == 90 and np.allclose(back[8:88], X[0][8:88], atol=1e-10)
    assert np.allclose(vector.imdct(got, p, 90), back) and len(vector.imdct(np.zeros((0, 8)), p)) == 0
    with pytest.raises(DimensionMismatch):
        vector.imdct(np.zeros((2, 5)), p)


def test_convolution(spark, long):
    h = np.array([0.5, -0.25, 0.125])
    response = spark.createDataFrame(list(enumerate(h.tolist())), "tap int, h double")
    full = convolution.convolve(long, response, 3).where("signal_id = 1").sort("n").toPandas()["x"]
    assert np.allclose(full, np.convolve(X[1], h)) and np.allclose(vector.fft_convolve(X[1], h), full)
    cut = convolution.filter_blocks(long, response, 3).where("signal_id = 1").sort("n").toPandas()["x"]
    assert np.allclose(cut, np.convolve(X[1], h)[:20])
    y = spark.createDataFrame([(0, n, float(v)) for n, v in enumerate(np.convolve(h, X[1][:6]))], "signal_id long, n long, x double")
    d = long.where("signal_id = 1 and n < 6").withColumn("signal_id", F.lit(0).cast("long"))
    assert np.allclose(convolution.deconvolve(y, d, 8, 6, 0.0).sort("n").toPandas()["x"], h, atol=1e-6)


def test_minimum_phase_keeps_magnitudes():
    n = np.arange(64) - 31.5
    h = 0.3 * np.sinc(0.3 * n) * np.hamming(64)
    m = vector.minimum_phase(h)
    assert np.allclose(np.abs(np.fft.rfft(m, 1024)), np.abs(np.fft.rfft(h, 1024)), atol=1e-2)
    assert (m[:32] ** 2).sum() > 0.9 * (m**2).sum()
    with pytest.raises(InvalidInput):
        vector.minimum_phase(np.zeros(0))


def test_gammatone_follows_its_recurrence():
    e = ErbParams(3, 200.0, 4000.0)
    got = vector.gammatone(X[0], RATE, 32, 16, e)
    numerators, poles = vector.gammatone_sections(fb.erb_axis(e), RATE)
    frame = X[0][16:48] * np.hanning(32)
    for band in range(3):
        y = frame
        for n0, n1 in numerators[:, :, band]:
            out = np.zeros(32)
            for i in range(32):
                out[i] = n0 * y[i] + (n1 * y[i - 1] if i else 0) - (poles[0, band] * out[i - 1] if i else 0) - (poles[1, band] * out[i - 2] if i > 1 else 0)
            y = out
        assert np.isclose(got[1, band], np.sqrt((y**2).mean()))
    with pytest.raises(InvalidInput):
        vector.gammatone(X[1], RATE, 32, 16, e)


def test_images(spark):
    v = RNG.standard_normal((6, 8))
    img = spark.createDataFrame([(0, r, c, float(v[r, c])) for r in range(6) for c in range(8)], "image_id long, r int, c int, v double")

    def array(df, rows, cols, value="v"):
        out = np.zeros((rows, cols))
        for r in df.collect():
            out[r.r, r.c] = r[value]
        return out

    z = image.fft2d(img, 6, 8)
    assert np.allclose(array(z, 6, 5, "re") + 1j * array(z, 6, 5, "im"), np.fft.rfft2(v), atol=1e-10)
    assert np.allclose(array(image.ifft2d(z, 6, 8), 6, 8), v, atol=1e-10)
    low, high = array(image.lowpass(img, 6, 8, 0.7), 6, 8), array(image.highpass(img, 6, 8, 0.7), 6, 8)
    assert np.allclose(low + high, v, atol=1e-10) and np.allclose(low, vector.filter_2d(v, vector.lowpass_mask(6, 8, 0.7)), atol=1e-10)
    kernel = image.gaussian_kernel(spark, 3, 1.0)
    assert abs(kernel.agg(F.sum("w")).first()[0] - 1) < 1e-12
    assert np.allclose(array(image.convolve(img, kernel, 6, 8, 3, 3), 6, 8), vector.convolve_2d(v, array(kernel, 3, 3, "w")), atol=1e-10)
    assert np.allclose(array(image.shift_2d(img, 6, 8), 6, 8), np.fft.fftshift(v))
    odd = image.shift_2d(image.shift_2d(img.where("r < 5"), 5, 8), 5, 8, True)
    assert np.allclose(array(odd, 5, 8), v[:5])
    for bad in (lambda: image.lowpass(img, 6, 8, 1.5), lambda: image.bandpass(img, 6, 8, 0.5, 0.5), lambda: image.gaussian_kernel(spark, 4, 1.0), lambda: image.gaussian_kernel(spark, 3, 0.0), lambda: image.sharpen(img, 6, 8, -1.0)):
        with pytest.raises(InvalidInput):
            bad()


def test_binaural(spark):
    i = np.arange(256)
    rows = [(0, int(n), float(np.sin(0.05 * n)), float(np.sin(0.05 * n + 0.3))) for n in i] + [(1, int(n), float(np.cos(0.4 * n)), 0.0) for n in i]
    stereo = spark.createDataFrame(rows, "pair_id long, n long, left double, right double")
    p = BinauralParams(SpectroParams(StftParams(64, 32), RATE), 500.0, 4000.0, wrapped=True)
    ipd = binaural.phase_difference(stereo, p).where("pair_id = 0").toPandas()
    assert ipd["value"].between(-np.pi, np.pi).all() and set(ipd["bin"]) == set(range(2, 16))
    l = np.fft.rfft(vector.framed(np.array([r[2] for r in rows[:256]]), p.spectro.stft), axis=1)
    r = np.fft.rfft(vector.framed(np.array([r[3] for r in rows[:256]]), p.spectro.stft), axis=1)
    ild = binaural.level_difference(stereo, p).where("pair_id = 0").toPandas()
    assert np.allclose(ild["value"], -20 * np.log10(np.abs(r) / np.abs(l))[ild["frame"], ild["bin"]], atol=1e-6)
    assert binaural.level_difference(stereo, p).where("pair_id = 1").toPandas()["value"].isna().all()
    h = binaural.histogram(binaural.phase_difference(stereo, p), "phase", 10).where("pair_id = 0")
    assert h.agg(F.sum("value")).first()[0] == len(ipd)
    share = binaural.histogram(binaural.level_difference(stereo, p), "level", 10, normalize=True).where("pair_id = 0").groupBy("frame").agg(F.sum("value").alias("s")).toPandas()["s"]
    assert all(abs(s - 1) < 1e-9 or s == 0 for s in share)
    itd = binaural.time_difference(stereo.where("pair_id = 0"), p)
    means, summary = binaural.time_comparison(itd, itd)
    assert means.agg(F.max(F.abs("value"))).first()[0] == 0 and summary.first().median_s == 0


def test_sources_sinks_and_transformers(spark, packed, long, tmp_path):
    again = src.to_packed(long.where("signal_id = 1")).first().samples
    assert np.allclose(again, X[1])
    spec = spectro.linear(long, P).where("signal_id = 0")
    assert sinks.to_matrix(spec, dtype="f32").dtype == np.float32 and np.allclose(sinks.to_matrix(spec).T, slow_power(X[0], P.stft), atol=1e-9)
    with pytest.raises(ValueError, match="dtype"):
        sinks.to_matrix(spec, dtype="int")
    marked = sinks.with_metadata(spec, "value", freq_scale="linear", sample_rate=RATE)
    marked.write.parquet(f"{tmp_path}/p")
    assert sinks.metadata(spark.read.parquet(f"{tmp_path}/p"), "value")["freq_scale"] == "linear"
    sinks.write_json(spec, f"{tmp_path}/j")
    assert sinks.read_json(spark, f"{tmp_path}/j", spec.schema).count() == spec.count()
    assert set(sinks.transpose(spec).columns) == set(spec.columns) and "n_fft" in sinks.describe(P)
    padded = src.pad_to_longest(spectro.linear(long, P))
    assert padded.groupBy("signal_id").count().select("count").distinct().count() == 1
    for t in (transformers.planned("mel", "db", P, MelParams(5, 0.0, 8000.0), LogParams()), transformers.gammatone(RATE, 16, 8, ErbParams(3, 100.0, 4000.0)), transformers.cqt_magnitude(P, CqtParams(3, 2, 900.0)), transformers.chroma(P, ChromaParams()), transformers.mfcc(P, 8, MfccParams(5, False))):
        rows = t.transform(packed).where("signal_id = 0").sort("frame").toPandas()
        assert len(rows["bands"][0]) == t.n_bands() == len(t.centre_frequencies()) and t.hop_seconds() > 0 and t.sample_rate() == RATE


def test_plan_names():
    planner = Planner()
    for kind in ("mel", "erb", "log_hz", "cqt"):
        for scale in ("power", "magnitude", "db"):
            assert callable(getattr(planner, f"{kind}_{scale}"))
    with pytest.raises(AttributeError):
        planner.mel_loudness  # noqa: B018


def test_filters_reach_the_scan(spark, tmp_path, packed):
    packed.withColumn("extra", F.lit("x" * 100)).write.parquet(f"{tmp_path}/s")
    table = spark.read.parquet(f"{tmp_path}/s")
    plan = Planner().linear_power(P).compute(table).where("signal_id = 1")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(signal_id), EqualTo(signal_id,1)]" in plan and "extra" not in plan.split("ReadSchema")[-1]
