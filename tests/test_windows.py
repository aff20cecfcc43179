import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sonoplan.errors import InvalidInput
from sonoplan.functions.windows import Window, bessel_i0
from sonoplan.params import BinauralParams, CqtParams, ErbParams, LogHzParams, LogParams, MdctParams, MelParams, SpectroParams, StftParams


@pytest.mark.parametrize("n", [2, 7, 64])
def test_values_are_the_symmetric_windows(n):
    assert np.allclose(Window.hanning().values(n), np.hanning(n))
    assert np.allclose(Window.hamming().values(n), np.hamming(n))
    assert np.allclose(Window.blackman().values(n), np.blackman(n))
    assert np.allclose(Window.kaiser(3.0).values(n), np.kaiser(n, 3.0), atol=1e-6)
    assert np.allclose(Window.rectangular().values(n), 1)


def test_bessel_near_is_the_published_one():
    assert np.allclose(bessel_i0(np.linspace(0, 3.7, 20)), np.i0(np.linspace(0, 3.7, 20)), rtol=1e-6)


def test_columns_equal_values(spark):
    for w in (Window.hanning(), Window.hamming(), Window.blackman(), Window.kaiser(2.5), Window.kaiser(8.0), Window.gaussian(4.0), Window.rectangular(), Window.custom(range(1, 17))):
        rows = w.table(spark, 16).sort("i").toPandas()
        assert np.allclose(rows["w"], w.values(16), atol=1e-12), w


@pytest.mark.parametrize("text", ["rect", "Rectangle", "rectangular", "hann", "HANNING", "hamm", "hamming", "blackman", "kaiser=5", "gaussian=0.4"])
def test_parse(text):
    w = Window.parse(text)
    assert Window.parse(str(w)).kind == w.kind


@pytest.mark.parametrize("text", ["", "kaiser", "kaiser=-1", "triangle", "gaussian="])
def test_parse_refuses(text):
    with pytest.raises(InvalidInput):
        Window.parse(text)


@pytest.mark.parametrize(("norm", "measure"), [("sum", np.sum), ("peak", np.max), ("max", np.max), ("energy", lambda v: np.sqrt((v * v).sum())), ("rms", lambda v: np.sqrt((v * v).sum()))])
def test_custom_normalisation(norm, measure):
    assert abs(measure(np.array(Window.custom([1, 2, 3, 2.5], norm).coefficients)) - 1) < 1e-12


def test_custom_refuses():
    for bad in ([], [float("nan")], [float("inf")]):
        with pytest.raises(InvalidInput):
            Window.custom(bad)
    with pytest.raises(InvalidInput):
        Window.custom([1, -1], "sum")
    with pytest.raises(InvalidInput):
        StftParams(8, 4, Window.custom([1, 2]))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 200), st.integers(1, 64), st.integers(1, 64), st.booleans())
def test_frame_count_is_the_number_of_whole_frames(n, n_fft, hop, centre):
    hop = min(hop, n_fft)
    p = StftParams(n_fft, hop, centre=centre)
    padded = n + 2 * p.pad
    assert p.frame_count(n) == max(1, len(range(0, padded - n_fft + 1, hop)))


def test_parameters_refuse_nonsense():
    ok = SpectroParams(StftParams(64, 32), 16000.0)
    for make in (
        lambda: StftParams(0, 1), lambda: StftParams(8, 9), lambda: SpectroParams(StftParams(8, 4), 0.0), lambda: SpectroParams(StftParams(8, 4), float("nan")), lambda: MelParams(0, 0, 1),
        lambda: MelParams(4, -1, 5), lambda: MelParams(4, 5, 5), lambda: MelParams(4, 0, 5, "l3"), lambda: LogHzParams(1, 1, 2), lambda: LogHzParams(4, 0, 2), lambda: LogParams(float("inf")),
        lambda: ErbParams(1, 0, 1), lambda: ErbParams(4, 5, 1), lambda: CqtParams(0, 1, 1), lambda: CqtParams(1, 1, 0), lambda: MdctParams(6, 0), lambda: MdctParams(5, 1), lambda: MdctParams.sine(3),
        lambda: BinauralParams(ok, 0, 100), lambda: BinauralParams(ok, 500, 100), lambda: BinauralParams(ok, 500, 9000), lambda: BinauralParams(ok, 500, 501).bins, lambda: BinauralParams(ok, 1, 500).without_dc(),
    ):
        with pytest.raises(InvalidInput):
            make()


def test_presets():
    assert (SpectroParams.speech().stft.n_fft, SpectroParams.speech().stft.hop) == (512, 160)
    assert (SpectroParams.music().stft.n_fft, SpectroParams.music().stft.hop) == (2048, 512)
    assert MelParams.standard(16000).n_mels == 128 and MelParams.speech().n_mels == 40 and ErbParams.music(44100).n_filters == 64 and LogHzParams.music().n_bins == 84
