import numpy as np
import pytest

from sonoplan import api
from sonoplan.functions import sql
from sonoplan.functions.windows import Window
from sonoplan.operators import filterbanks as fb
from sonoplan.params import ChromaParams, CqtParams, ErbParams, LogHzParams, LogParams, MelParams, MfccParams, SpectroParams, StftParams

P = SpectroParams(StftParams(64, 32), 16000.0)
X = np.random.default_rng(0).standard_normal(200)


@pytest.fixture(scope="module")
def packed(spark):
    return spark.createDataFrame([(0, X.tolist())], "signal_id long, samples array<double>")


def test_all_scales(packed):
    bands = {"linear": None, "mel": MelParams(6, 0.0, 8000.0), "erb": ErbParams(5, 100.0, 7000.0), "loghz": LogHzParams(5, 300.0, 8000.0), "cqt": CqtParams(3, 2, 900.0)}
    for kind, b in bands.items():
        power = np.array(getattr(api, f"compute_{kind}_power")(packed, P, b).first().frames)
        assert np.allclose(np.array(getattr(api, f"compute_{kind}_magnitude")(packed, P, b).first().frames) ** 2, power)
        assert np.allclose(getattr(api, f"compute_{kind}_db")(packed, P, b, LogParams(-30.0)).first().frames, 10 * np.log10(np.maximum(power, 1e-3)))


def test_spectra(packed):
    z = api.compute_fft(packed, 256).first()
    assert np.allclose(np.array(z.re) + 1j * np.array(z.im), np.fft.rfft(X, 256))
    assert np.allclose(api.compute_rfft(packed, 256).first().magnitudes, np.abs(np.fft.rfft(X, 256)))
    assert np.allclose(api.compute_irfft(api.compute_fft(packed, 256), 256).first().samples[:200], X)
    assert np.allclose(api.compute_istft(api.compute_stft(packed, P.stft), P.stft).first().samples[:192], X[:192])
    w = Window.hanning()
    want = np.abs(np.fft.rfft(np.pad(X, (0, 56)) * w.values(256))) ** 2
    assert np.allclose(api.compute_power_spectrum(packed, 256, w).first().power, want)
    assert np.allclose(api.compute_magnitude_spectrum(packed, 256, w).first().magnitudes, np.sqrt(want))
    assert len(api.compute_mfcc(packed, P, 8, MfccParams(5)).first().frames[0]) == 5
    assert len(api.compute_chromagram(packed, P, ChromaParams()).first().frames[0]) == 12
    assert np.allclose(api.ifft_c2c(api.fft_c2c(X)), X * 200)


def test_sql_functions(spark):
    sql.register(spark)
    row = spark.sql("SELECT hz_to_mel(4000D) a, mel_to_hz(hz_to_mel(4000D)) b, erb_to_hz(hz_to_erb(500D)) c, power_to_db(0D, -80D) d, wrap_phase(4D) e, hann(3, 9) f, frame_count(720, 64, 32, true) g").first()
    assert row.a == pytest.approx(float(fb.hz_to_mel(4000))) and row.b == pytest.approx(4000) and row.c == pytest.approx(500) and row.d == pytest.approx(-80)
    assert row.e == pytest.approx(4 - 2 * np.pi) and row.f == pytest.approx(np.hanning(9)[3]) and row.g == 23
