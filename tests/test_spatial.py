import numpy as np
import pytest
from pyspark.sql import functions as F

from sonoplan import api
from sonoplan.errors import DimensionMismatch, InvalidInput
from sonoplan.operators import binaural as bi
from sonoplan.params import BinauralParams, MelParams, SpectroParams, StftParams
from sonoplan.plans import spatial, vector
from sonoplan.sources import sinks

RNG = np.random.default_rng(11)


def rows_of(df, name="frames"):
    return np.array(df.first()[name])


@pytest.mark.parametrize("n_fft", [512, 2048])
def test_cues_of_production_size(spark, n_fft):
    l, r = RNG.standard_normal((2, 3 * n_fft))
    p = BinauralParams(SpectroParams(StftParams(n_fft, n_fft // 2), 16000.0), 200.0, 4600.0, wrapped=True)
    pairs = spark.createDataFrame([(1, l.tolist(), r.tolist())], "pair_id long, left array<double>, right array<double>")
    w, pad = p.spectro.stft.window.values(n_fft), n_fft // 2
    frames = lambda x: np.lib.stride_tricks.sliding_window_view(np.pad(x, pad), n_fft)[:: n_fft // 2] * w
    zl, zr = (np.fft.rfft(frames(x))[:, p.bins.start : p.bins.stop] for x in (l, r))
    turn = np.angle(zl * np.conj(zr))
    assert np.allclose(np.exp(1j * rows_of(api.compute_ipd(pairs, p))), np.exp(1j * turn))
    assert np.allclose(rows_of(api.compute_itd(pairs, p)), turn / (2 * np.pi * np.array(p.bins) * 16000 / n_fft), atol=1e-9)
    assert np.allclose(rows_of(api.compute_ild(pairs, p)), 20 * np.log10(np.abs(zl) / np.abs(zr)))
    ratio = np.abs(zr) / np.abs(zl)
    assert np.allclose(rows_of(api.compute_ilr(pairs, p)), np.where(ratio < 1, 1 - ratio, 1 / ratio - 1))
    cells = spatial.BinauralPlan(p, "ild").long(pairs)
    assert cells.agg(F.min("bin"), F.max("bin")).first()[:] == (p.bins.start, p.bins.stop - 1)
    assert bi.histogram(cells, "level", 20).where("frame = 0").count() == 20


def test_silence_is_masked(spark):
    p = BinauralParams(SpectroParams(StftParams(64, 64, centre=False), 16000.0), 500.0, 7500.0)
    zero, one = np.zeros(64), RNG.standard_normal(64)
    plan = lambda c: spatial.BinauralPlan(p, c)
    assert (plan("itd").matrix(zero, zero) == 0).all() and np.isnan(plan("ild").matrix(zero, one)).all() and np.isnan(plan("ilr").matrix(one, zero)).all()
    assert plan("itd").unit == "s"
    m, phase = spatial.magphase(np.array([0j, 3 + 4j]), 2)
    assert m.tolist() == [0, 25] and np.allclose(phase, [1, 0.6 + 0.8j])
    with pytest.raises(DimensionMismatch):
        plan("itd").matrix(zero, one[:5])
    with pytest.raises(InvalidInput):
        plan("loudness")


@pytest.mark.parametrize("shape", [(256, 256), (512, 512), (130, 257)])
def test_images_of_production_size(spark, shape):
    x = RNG.standard_normal(shape)
    images = spark.createDataFrame([(1, x.ravel().tolist())], "image_id long, pixels array<double>")
    z = api.compute_fft2d(images, shape).first()
    assert np.allclose((np.array(z.re) + 1j * np.array(z.im)).reshape(shape[0], -1), np.fft.rfft2(x))
    assert np.allclose(rows_of(api.compute_ifft2d(api.compute_fft2d(images, shape), shape), "pixels"), x.ravel())
    assert np.allclose(rows_of(api.compute_power_2d(images, shape), "power"), np.abs(np.fft.rfft2(x)).ravel() ** 2)
    assert np.allclose(rows_of(api.compute_magnitude_2d(images, shape), "magnitudes"), np.abs(np.fft.rfft2(x)).ravel())
    low, high = (rows_of(f(images, shape, 0.3), "pixels") for f in (api.compute_lowpass, api.compute_highpass))
    assert np.allclose(low + high, x.ravel()) and np.abs(low).sum() > 1
    band = rows_of(api.compute_bandpass(images, shape, 0.2, 0.6), "pixels")
    assert np.allclose(band, rows_of(api.compute_lowpass(images, shape, 0.6), "pixels") - rows_of(api.compute_lowpass(images, shape, 0.2), "pixels"))
    assert np.allclose(rows_of(api.compute_edges(images, shape), "pixels"), rows_of(api.compute_highpass(images, shape, 0.1), "pixels"))
    assert np.allclose(rows_of(api.compute_sharpen(images, shape, 1.5), "pixels"), x.ravel() + 1.5 * rows_of(api.compute_highpass(images, shape, 0.2), "pixels"))
    one = np.zeros((3, 3))
    one[1, 1] = 1
    assert np.allclose(rows_of(api.compute_convolve_2d(images, shape, one), "pixels"), x.ravel())
    with pytest.raises(InvalidInput):
        api.compute_bandpass(images, shape, 0.6, 0.2)


def test_quotients_of_any_length(spark):
    x, h = RNG.standard_normal(2048), np.exp(-np.arange(300) / 20) * RNG.standard_normal(300)
    h[0] = 8
    y = np.fft.irfft(np.fft.rfft(x) * np.fft.rfft(h, 2048))
    rows = spark.createDataFrame([(1, y.tolist(), h.tolist())], "signal_id long, numerator array<double>, denominator array<double>")
    assert np.allclose(rows_of(api.compute_deconvolution(rows, 0.0), "samples"), x[: 2048 - 300 + 1])
    assert len(spatial.deconvolve(h[:5], h, 0.1)) == 5 and (spatial.deconvolve(x, np.zeros(4), 0.1) == 0).all()


def test_long_modulation_and_complex_transforms(spark):
    x = RNG.standard_normal(64 * 200)
    p = SpectroParams(StftParams(256, 64), 16000.0)
    packed = spark.createDataFrame([(1, x.tolist())], "signal_id long, samples array<double>")
    out = api.compute_modulation(packed, p, MelParams(20, 0.0, 8000.0)).toPandas()
    frames = p.stft.frame_count(len(x))
    assert frames > 128 and len(out) == 20 * (frames // 2 + 1) and out["v"].idxmax() == 10 * (frames // 2 + 1) + (frames // 2 + 1 - (frames // 2 + 1) // 2)
    z = x[:500] + 1j * x[500:1000]
    rows = spark.createDataFrame([(1, z.real.tolist(), z.imag.tolist())], "signal_id long, re array<double>, im array<double>")
    there = api.compute_fft_c2c(rows)
    got = there.first()
    assert np.allclose(np.array(got.re) + 1j * np.array(got.im), np.fft.fft(z))
    back = api.compute_ifft_c2c(there).first()
    assert np.allclose(np.array(back.re) + 1j * np.array(back.im), 500 * z)


def test_batches_and_parameters(spark):
    rows = [(k, f, b, float(10 * k + f + b)) for k, n in ((1, 3), (2, 2)) for f in range(n) for b in range(2)]
    df = spark.createDataFrame(rows, "signal_id long, frame int, bin int, value double")
    with pytest.raises(DimensionMismatch):
        sinks.batch(df)
    keys, values = sinks.batch(df, pad=-1.0)
    assert keys == [1, 2] and values.shape == (2, 2, 3) and values[1, :, 2].tolist() == [-1, -1] and values[0, 1, 2] == 13
    whole = sinks.batch_with_metadata(df.where("frame < 2"), [0.0, 8000.0], 64, 16000.0)
    assert whole["times"].tolist() == [0, 0.004] and whole["db_range"][1] == pytest.approx(10 * np.log10(22))
    assert sinks.norm(df, order=1).first().norm == pytest.approx(sum(r[3] for r in rows)) and sinks.norm(df, order=float("inf")).first().norm == 22
    assert sinks.corner(df).count() == 4
    for p in (SpectroParams(StftParams(512, 128), 44100.0), BinauralParams(SpectroParams(StftParams(64, 64), 16000.0), 500.0, 7000.0, 2.0, True), MelParams(12, 0.0, 8000.0)):
        assert sinks.parameters(type(p), sinks.describe(p)) == p
