"""DuckDB SQL of the queries, from closed forms: nothing here shares code with the plans that it checks."""

from __future__ import annotations

PI = "pi()"
#: Coefficients of the published polynomials of I0.
NEAR = "1.0e0 + {t} * (3.5156229e0 + {t} * (3.0899424e0 + {t} * (1.2067492e0 + {t} * (0.2659732e0 + {t} * (0.0360768e0 + {t} * 0.0045813e0)))))"
FAR = "0.39894228e0 + {t} * (0.01328592e0 + {t} * (0.00225319e0 + {t} * (-0.00157565e0 + {t} * (0.00916281e0 + {t} * (-0.02057706e0 + {t} * (0.02635537e0 + {t} * (-0.01647633e0 + {t} * 0.00392377e0)))))))"


def R(x: str, d: int = 6) -> str:
    return f"round({x}, {d}) + 0.0"


E = "e AS (SELECT vec_id AS signal_id, n, CAST(embedding[n + 1] AS DOUBLE) AS x FROM embeddings, (SELECT unnest(range(0, 64)) AS n))"
H = """sums AS (SELECT event_type AS signal_id, date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', date_trunc('hour', ts)) AS n, sum(CAST(round(value * 100) AS BIGINT)) / 100000e0 AS x FROM events GROUP BY ALL),
h AS (SELECT s.signal_id, g.n, coalesce(t.x, 0e0) AS x FROM (SELECT DISTINCT signal_id FROM sums WHERE n BETWEEN 0 AND 719) s CROSS JOIN (SELECT unnest(range(0, 720)) AS n) g LEFT JOIN sums t ON t.signal_id = s.signal_id AND t.n = g.n)"""
B = """pr AS (SELECT l.vec_id // 2 AS pair_id, n, CAST(l.embedding[n + 1] AS DOUBLE) AS l, CAST(r.embedding[n + 1] AS DOUBLE) AS r
  FROM embeddings l JOIN embeddings r ON r.vec_id = l.vec_id + 1 AND l.vec_id % 2 = 0, (SELECT unnest(range(0, 64)) AS n))"""


def hann(n: int, i: str = "i") -> str:
    return f"(0.5e0 - 0.5e0 * cos(2 * pi() * {i} / {n - 1}e0))"


def frames(source: str, n_fft: int, hop: int, pad: int, length: int, window: str) -> str:
    count = 1 if length + 2 * pad < n_fft else (length + 2 * pad - n_fft) // hop + 1
    return f"""f AS (SELECT s.signal_id, frame, i, coalesce(x, 0e0) * {window} AS v, x IS NOT NULL AS inside FROM (SELECT DISTINCT signal_id FROM {source}) s
  CROSS JOIN (SELECT unnest(range(0, {count})) AS frame) CROSS JOIN (SELECT unnest(range(0, {n_fft})) AS i) LEFT JOIN {source} x ON x.signal_id = s.signal_id AND x.n = frame * {hop} + i - {pad})"""


def dft(n_fft: int, keys: str = "signal_id, frame", source: str = "f", name: str = "z") -> str:
    turn = f"2 * pi() * ((k * i) % {n_fft}) / {n_fft}e0"
    return f"""{name} AS (SELECT {keys}, k AS bin, sum(v * cos({turn})) AS re, -sum(v * sin({turn})) AS im FROM {source} CROSS JOIN (SELECT unnest(range(0, {n_fft // 2 + 1})) AS k) GROUP BY {keys}, k)"""


STFT = f"{H}, {frames('h', 64, 32, 32, 720, hann(64))}, {dft(64)}"
POWER = f"{STFT}, p AS (SELECT signal_id, frame, CAST(bin AS INTEGER) AS bin, re * re + im * im AS v FROM z)"
#: Signals of one frame.
LINE = f"{E}, f AS (SELECT signal_id, 0 AS frame, n AS i, x AS v FROM e), {dft(64)}"


def amplitude(scale: str, v: str = "v") -> str:
    return {"power": v, "magnitude": f"sqrt({v})", "db": f"10 * log10(greatest({v}, 1e-8))"}[scale]


def mel_hz(m: str) -> str:
    return f"(CASE WHEN {m} < 15 THEN {m} * 200e0 / 3 ELSE 1000e0 * exp(({m} - 15) * ln(6.4e0) / 27) END)"


def mel_bank(n: int, norm: str = "none", high: float = 8000.0) -> str:
    top = f"(15e0 + ln({high} / 1000e0) / (ln(6.4e0) / 27))"
    points = f"mp AS (SELECT j, {mel_hz('m')} AS hz FROM (SELECT j, j * {top} / {n + 1} AS m FROM (SELECT unnest(range(0, {n + 2})) AS j)))"
    raw = f"""mr AS (SELECT l.j AS band, k AS bin, r.hz - l.hz AS width, least(1, greatest(0, least((k * 250e0 - l.hz) / (c.hz - l.hz), (r.hz - k * 250e0) / (r.hz - c.hz)))) AS w
      FROM mp l JOIN mp c ON c.j = l.j + 1 JOIN mp r ON r.j = l.j + 2 CROSS JOIN (SELECT unnest(range(0, 33)) AS k))"""
    scale = {"none": "w", "slaney": "w * 2 / width", "l1": "w / sum(w) OVER (PARTITION BY band)", "l2": "w / sqrt(sum(w * w) OVER (PARTITION BY band))"}[norm]
    return f"{points}, {raw}, fb AS (SELECT band, bin, {scale} AS w FROM mr WHERE w > 1e-10)"


LOGHZ_BANK = """lt AS (SELECT j AS band, exp(ln(250e0) + j * (ln(8000e0) - ln(250e0)) / 11) / 250e0 AS spot FROM (SELECT unnest(range(0, 12)) AS j)),
lp AS (SELECT band, floor(spot) AS lo, least(ceil(spot), 32) AS hi, spot - floor(spot) AS part FROM lt),
fb AS (SELECT band, CAST(lo AS INTEGER) AS bin, CASE WHEN lo = hi THEN 1e0 ELSE 1 - part END AS w FROM lp WHERE lo <= 32 UNION ALL SELECT band, CAST(hi AS INTEGER), part FROM lp WHERE hi > lo AND lo <= 32)"""


def erb_bank() -> str:
    return """ec AS (SELECT j AS band, 100e0 + j * (8000e0 - 100e0) / 7 AS fc FROM (SELECT unnest(range(0, 8)) AS j)),
fb AS (SELECT band, k AS bin, 1 / pow(1 + pow((k * 250e0 - fc) / (1.019e0 * 24.7e0 * (4.37e0 * fc / 1000 + 1)), 2), 4) AS w FROM ec CROSS JOIN (SELECT unnest(range(0, 33)) AS k))"""


CHROMA_BANK = """cb AS (SELECT k AS bin, 69 + 12 * log2(k * 250e0 / 440) AS midi FROM (SELECT unnest(range(1, 33)) AS k) WHERE k * 250 BETWEEN 32.7 AND 4186),
cd AS (SELECT band, bin, abs(midi - 12 * floor(midi / 12) - band) AS d FROM cb CROSS JOIN (SELECT unnest(range(0, 12)) AS band)),
cw AS (SELECT band, bin, exp(-0.5 * pow(least(d, 12 - d), 2)) AS w FROM cd),
fb AS (SELECT band, bin, w / sum(w) OVER (PARTITION BY band) AS w FROM cw)"""

CQT_KERNEL = """kf AS (SELECT j AS bin, 500e0 * pow(2, j / 6e0) AS f FROM (SELECT unnest(range(0, 18)) AS j)),
kl AS (SELECT bin, f, least(64, greatest(1, CAST(floor(16000e0 / (pow(2, 1 / 6e0) - 1) / f + 0.5) AS INTEGER))) AS len FROM kf WHERE f < 8000),
kr AS (SELECT bin, len, n, (0.5e0 - 0.5e0 * cos(2 * pi() * n / (len - 1))) AS w, 2 * pi() * f * n / 16000 AS a FROM (SELECT *, unnest(range(0, len)) AS n FROM kl)),
ks AS (SELECT bin, len, n, a, CASE WHEN abs(w) < 0.01 * max(abs(w)) OVER (PARTITION BY bin) THEN 0e0 ELSE w END AS w FROM kr),
kn AS (SELECT bin, len, n, w * cos(a) / sqrt(sum(w * w) OVER (PARTITION BY bin)) AS re, w * sin(a) / sqrt(sum(w * w) OVER (PARTITION BY bin)) AS im FROM ks)"""
CQT = f"""{H}, {frames("h", 64, 32, 32, 720, "1e0")}, {CQT_KERNEL},
z AS (SELECT signal_id, frame, bin, sum(v * re) AS re, -sum(v * im) AS im FROM f JOIN kn ON f.i = 64 - len + kn.n GROUP BY signal_id, frame, bin),
p AS (SELECT signal_id, frame, CAST(bin AS INTEGER) AS bin, re * re + im * im AS v FROM z)"""


def banded(bank: str, scale: str, digits: int) -> str:
    return f"""WITH {POWER}, {bank}, b AS (SELECT signal_id, frame, band, sum(w * v) AS v FROM p JOIN fb USING (bin) GROUP BY ALL)
SELECT signal_id, CAST(frame AS INTEGER) AS frame, CAST(band AS INTEGER) AS bin, {R(amplitude(scale), digits)} AS value FROM b"""


def mel_db(n: int) -> str:
    return f"{POWER}, {mel_bank(n)}, mb AS (SELECT signal_id, frame, band, 10 * log10(greatest(sum(w * v), 1e-8)) AS v FROM p JOIN fb USING (bin) GROUP BY ALL)"


def mfcc(drop: bool) -> str:
    return f"""WITH {mel_db(12)}, d AS (SELECT signal_id, frame, c, sum(v * cos(pi() * c * (band + 0.5e0) / 12)) * (1 + 11 * sin(pi() * c / 22)) AS v FROM mb CROSS JOIN (SELECT unnest(range(0, 6)) AS c) GROUP BY signal_id, frame, c)
SELECT signal_id, CAST(frame AS INTEGER) AS frame, CAST(c - {int(drop)} AS INTEGER) AS bin, {R("v", 5)} AS value FROM d {"WHERE c > 0" if drop else ""}"""


def chroma(norm: str) -> str:
    size = {"none": "1e0", "l1": "sum(v) OVER w", "l2": "sqrt(sum(v * v) OVER w)", "max": "max(v) OVER w"}[norm]
    return f"""WITH {POWER}, {CHROMA_BANK}, b AS (SELECT signal_id, frame, band, sum(w * sqrt(v)) AS v FROM p JOIN fb USING (bin) GROUP BY ALL),
s AS (SELECT *, {size} AS size FROM b WINDOW w AS (PARTITION BY signal_id, frame))
SELECT signal_id, CAST(frame AS INTEGER) AS frame, CAST(band AS INTEGER) AS bin, {R("CASE WHEN size > 0 THEN v / size ELSE v END")} AS value FROM s"""


def images(source: str) -> str:
    if source == "e":
        return f"{E}, im AS (SELECT signal_id AS image_id, n // 8 AS r, n % 8 AS c, x AS v FROM e)"
    return f"{H}, im AS (SELECT signal_id AS image_id, n % 24 AS r, n // 24 AS c, x AS v FROM h)"


def fft2(rows: int, cols: int, source: str = "im", name: str = "s2") -> str:
    a, b = f"2 * pi() * ((c * kc) % {cols}) / {cols}e0", f"2 * pi() * ((r * kr) % {rows}) / {rows}e0"
    return f"""{name}_1 AS (SELECT image_id, r, kc, sum(v * cos({a})) AS re, -sum(v * sin({a})) AS im FROM {source} CROSS JOIN (SELECT unnest(range(0, {cols // 2 + 1})) AS kc) GROUP BY image_id, r, kc),
{name} AS (SELECT image_id, kr AS r, kc AS c, sum(re * cos({b}) + im * sin({b})) AS re, sum(im * cos({b}) - re * sin({b})) AS im FROM {name}_1 CROSS JOIN (SELECT unnest(range(0, {rows})) AS kr) GROUP BY image_id, kr, kc)"""


def ifft2(rows: int, cols: int, source: str = "s2", name: str = "y2") -> str:
    a, b = f"2 * pi() * ((c * x) % {cols}) / {cols}e0", f"2 * pi() * ((r * y) % {rows}) / {rows}e0"
    edge = "c = 0" + (f" OR c = {cols // 2}" if cols % 2 == 0 else "")
    return f"""{name}_1 AS (SELECT image_id, y, c, sum(re * cos({b}) - im * sin({b})) AS re, sum(im * cos({b}) + re * sin({b})) AS im FROM {source} CROSS JOIN (SELECT unnest(range(0, {rows})) AS y) GROUP BY image_id, y, c),
{name} AS (SELECT image_id, y AS r, x AS c, sum(CASE WHEN {edge} THEN re * cos({a}) ELSE 2 * (re * cos({a}) - im * sin({a})) END) / {rows * cols} AS v FROM {name}_1 CROSS JOIN (SELECT unnest(range(0, {cols})) AS x) GROUP BY image_id, y, x)"""


def mask(rows: int, cols: int, cutoff: float) -> str:
    half = cols // 2 + 1
    radius = (min(rows // 2, half // 2) * cutoff) ** 2
    return f"(CASE WHEN pow(least(r, {rows} - r), 2) + pow(least(c, {half} - c), 2) <= {radius!r}e0 THEN 1 ELSE 0 END)"


def filtered(source: str, rows: int, cols: int, m: str) -> str:
    return f"{images(source)}, {fft2(rows, cols)}, m2 AS (SELECT image_id, r, c, re * {m} AS re, im * {m} AS im FROM s2), {ifft2(rows, cols, 'm2')}"


PIXELS = "image_id, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c"

STEREO = f"""{B}, fb2 AS (SELECT pair_id, n AS i, l * {hann(64, "n")} AS l, r * {hann(64, "n")} AS r FROM pr),
zb AS (SELECT pair_id, k AS bin, sum(l * cos(t)) AS lr, -sum(l * sin(t)) AS li, sum(r * cos(t)) AS rr, -sum(r * sin(t)) AS ri
  FROM (SELECT *, 2 * pi() * ((k * i) % 64) / 64e0 AS t FROM fb2 CROSS JOIN (SELECT unnest(range(2, 30)) AS k)) GROUP BY pair_id, k),
zc AS (SELECT *, sqrt(lr * lr + li * li) AS lm, sqrt(rr * rr + ri * ri) AS rm, atan2(li, lr) - atan2(ri, rr) AS ph FROM zb)"""
WRAP = "(ph + pi() - floor((ph + pi()) / (2 * pi())) * 2 * pi() - pi())"
CUES = {
    "itd": f"{WRAP} / (2 * pi() * 250 * bin)", "ipd": "ph", "ipd_wrapped": WRAP,
    "ild": "CASE WHEN lm > 0 AND rm > 0 THEN -20 * log10(rm / lm) END",
    "ilr": "CASE WHEN lm > 0 AND rm > 0 THEN CASE WHEN rm < lm THEN 1 - rm / lm ELSE lm / rm - 1 END END",
}


def cue(name: str) -> str:
    return f"WITH {STEREO} SELECT pair_id, 0 AS frame, CAST(bin AS INTEGER) AS bin, {R(CUES[name], 9 if name == 'itd' else 6)} AS value FROM zc"


def cue_histogram(name: str, most: str, power: int, normalize: bool) -> str:
    value = CUES["ipd_wrapped" if name == "ipd" else name]
    share = "CASE WHEN sum(v) OVER w > 0 THEN v / sum(v) OVER w ELSE v END" if normalize else "v"
    return f"""WITH {STEREO}, cv AS (SELECT pair_id, {R(value, 9)} AS x FROM zc),
ch AS (SELECT pair_id, least(CAST(floor((x + {most}) / (2 * {most} / 20)) AS INTEGER), 19) AS bin, count(*) AS n FROM cv WHERE x BETWEEN -{most} AND {most} GROUP BY ALL),
cg AS (SELECT pair_id, b AS bin, pow(coalesce(n, 0), {power}) AS v FROM (SELECT DISTINCT pair_id FROM cv) CROSS JOIN (SELECT unnest(range(0, 20)) AS b) LEFT JOIN ch USING (pair_id) WHERE ch.bin = b OR ch.bin IS NULL
  UNION ALL SELECT pair_id, b, 0 FROM (SELECT DISTINCT pair_id FROM ch) g CROSS JOIN (SELECT unnest(range(0, 20)) AS b) WHERE NOT EXISTS (SELECT 1 FROM ch WHERE ch.pair_id = g.pair_id AND ch.bin = b))
SELECT pair_id, 0 AS frame, CAST(bin AS INTEGER) AS bin, {R(share, 9)} AS value FROM cg WINDOW w AS (PARTITION BY pair_id)"""


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["frame_count"] = f"WITH {H} SELECT signal_id, CAST((max(n) + 1 + 64 - 64) // 32 + 1 AS BIGINT) AS n_frames FROM h GROUP BY signal_id"
    axis = "FROM (SELECT unnest(range(0, 33)) AS i)"
    near, far = NEAR.format(t="pow(u / 3.75e0, 2)"), FAR.format(t="(3.75e0 / u)")
    at5 = "(exp(5e0) / (sqrt(5e0) * sqrt(2 * pi())) * (" + FAR.format(t="0.75e0") + "))"
    windows = {
        "rect": "1e0", "hann": hann(33), "hamming": "0.54e0 - 0.46e0 * cos(2 * pi() * i / 32)", "blackman": "0.42e0 - 0.5e0 * cos(2 * pi() * i / 32) + 0.08e0 * cos(4 * pi() * i / 32)",
        "kaiser": f"(CASE WHEN u <= 3.75 THEN {near} ELSE exp(u) / (sqrt(u) * sqrt(2 * pi())) * ({far}) END) / {at5}", "gaussian": "exp(-0.5e0 * pow((i - 16) / 6e0, 2))",
    }
    for name, w in windows.items():
        q[f"window_{name}"] = f"SELECT CAST(i AS INTEGER) AS i, {R(w, 9)} AS value FROM (SELECT i, 5 * sqrt(greatest(0, 1 - pow((i - 16) / 16e0, 2))) AS u {axis})"
    for name, size in (("sum", "sum(c) OVER ()"), ("peak", "max(c) OVER ()"), ("energy", "sqrt(sum(c * c) OVER ())")):
        q[f"window_custom_norm_{name}"] = f"SELECT CAST(i AS INTEGER) AS i, {R('c / ' + size, 9)} AS value FROM (SELECT i, CAST(1 + i % 7 AS DOUBLE) AS c {axis})"
    cells = f"SELECT signal_id, CAST(frame AS INTEGER) AS frame, i, {R('v')} AS v FROM f WHERE inside"
    q["frames_windowed"] = f"WITH {H}, {frames('h', 64, 32, 32, 720, hann(64))} {cells}"
    q["frames_uncentred"] = f"WITH {H}, {frames('h', 64, 32, 0, 720, hann(64))} {cells}"
    bins = "signal_id, CAST(bin AS INTEGER) AS bin"
    q["fft_complex"] = f"WITH {LINE} SELECT {bins}, {R('re')} AS re, {R('im')} AS im FROM z"
    q["fft_zero_padded"] = f"WITH {E}, f AS (SELECT signal_id, 0 AS frame, n AS i, x AS v FROM e), {dft(96)} SELECT {bins}, {R('re')} AS re, {R('im')} AS im FROM z"
    q["rfft_magnitude"] = f"WITH {LINE} SELECT {bins}, {R('sqrt(re * re + im * im)')} AS value FROM z"
    windowed = lambda w: f"{E}, f AS (SELECT signal_id, 0 AS frame, n AS i, x * {w} AS v FROM e), {dft(64)}"
    q["power_spectrum"] = f"WITH {windowed(hann(64, 'n'))} SELECT {bins}, {R('re * re + im * im')} AS value FROM z"
    q["magnitude_spectrum"] = f"WITH {windowed('(0.54e0 - 0.46e0 * cos(2 * pi() * n / 63e0))')} SELECT {bins}, {R('sqrt(re * re + im * im)')} AS value FROM z"
    q["irfft_roundtrip"] = f"WITH {E} SELECT signal_id, n, {R('x')} AS x FROM e"
    q["stft_complex"] = f"WITH {STFT} SELECT signal_id, CAST(frame AS INTEGER) AS frame, CAST(bin AS INTEGER) AS bin, {R('re', 5)} AS re, {R('im', 5)} AS im FROM z"
    turn = "2 * pi() * ((bin * i) % 64) / 64e0"
    q["istft_reconstruct"] = f"""WITH {STFT}, y AS (SELECT signal_id, frame, i, sum((CASE WHEN bin IN (0, 32) THEN 1 ELSE 2 END) * (re * cos({turn}) - im * sin({turn}))) / 64 AS y FROM z CROSS JOIN (SELECT unnest(range(0, 64)) AS i) GROUP BY signal_id, frame, i),
o AS (SELECT signal_id, frame * 32 + i - 32 AS n, sum(y * {hann(64)}) AS y, sum(pow({hann(64)}, 2)) AS w FROM y GROUP BY ALL)
SELECT signal_id, n, {R("CASE WHEN w > 1e-10 THEN y / w ELSE y END")} AS x FROM o WHERE n >= 0 AND n < 22 * 32 + 64 - 64"""
    banks = {"mel": mel_bank(12), "loghz": LOGHZ_BANK, "erb": erb_bank()}
    for scale, d in (("power", 4), ("magnitude", 5), ("db", 5)):
        line = f"SELECT signal_id, CAST(frame AS INTEGER) AS frame, bin, {R(amplitude(scale), d)} AS value FROM p"
        own = {"linear": f"WITH {POWER} {line}", "cqt": f"WITH {CQT} {line}"} | {k: banded(b, scale, d) for k, b in banks.items()}
        for kind, sql in own.items():
            q[f"{kind}_{scale}"] = q[f"{kind}_{scale}_fast"] = sql
    cells = f"SELECT CAST(band AS INTEGER) AS band, CAST(bin AS INTEGER) AS bin, {R('w', 9)} AS value FROM fb"
    for norm in ("none", "slaney", "l1", "l2"):
        q[f"mel_filterbank_{norm}"] = f"WITH {mel_bank(12, norm)} {cells}"
    q["loghz_filterbank"] = f"WITH {LOGHZ_BANK} {cells} WHERE w > 1e-10"
    q["erb_filterbank"] = f"WITH {erb_bank()} {cells}"
    q["chroma_filterbank"] = f"WITH {CHROMA_BANK} {cells}"
    top = "(15e0 + ln(8e0) / (ln(6.4e0) / 27))"
    j8 = "(SELECT unnest(range(0, 8)) AS j)"
    q["mel_axis"] = f"SELECT CAST(j - 1 AS INTEGER) AS bin, {R(mel_hz('m'))} AS value FROM (SELECT j, j * {top} / 13 AS m FROM (SELECT unnest(range(1, 13)) AS j))"
    q["erb_linear_centres"] = f"SELECT CAST(j AS INTEGER) AS bin, {R('100e0 + j * 7900e0 / 7')} AS value FROM {j8}"
    shift = "(9.26449e0 * 24.7e0)"
    q["erb_tr35_centres"] = f"SELECT CAST(j AS INTEGER) AS bin, {R(f'exp((8 - j) * (ln(100 + {shift}) - ln(8000 + {shift})) / 8) * (8000 + {shift}) - {shift}')} AS value FROM {j8}"
    q["cqt_kernel"] = f"WITH {CQT_KERNEL} SELECT CAST(bin AS INTEGER) AS bin, CAST(n AS INTEGER) AS n, {R('re', 9)} AS re, {R('im', 9)} AS im FROM kn"
    q["cqt_complex"] = f"WITH {CQT} SELECT signal_id, CAST(frame AS INTEGER) AS frame, CAST(bin AS INTEGER) AS bin, {R('re')} AS re, {R('im')} AS im FROM z"
    q["linear_axes"] = f"WITH {POWER} SELECT signal_id, CAST(frame AS INTEGER) AS frame, bin, {R('sqrt(v)', 5)} AS value, {R('bin * 250e0', 5)} AS freq_hz, {R('frame * 32 / 16000e0', 5)} AS time_s FROM p"
    q["db_range"] = f"WITH {POWER} SELECT {R('min(10 * log10(v + 1e-12))', 5)} AS low, {R('max(10 * log10(v + 1e-12))', 5)} AS high FROM p"
    q["statistics"] = f"WITH {POWER} SELECT count(*) AS n, {R('min(sqrt(v))', 5)} AS minimum, {R('max(sqrt(v))', 5)} AS maximum, {R('avg(sqrt(v))', 5)} AS mean FROM p"
    q["duration"] = f"WITH {POWER} SELECT signal_id, {R('max(frame) * 32 / 16000e0', 9)} AS duration_s FROM p GROUP BY signal_id"
    q["one_frame"] = f"WITH {POWER} SELECT signal_id, CAST(frame AS INTEGER) AS frame, bin, {R('v', 4)} AS value FROM p WHERE frame = 3"
    mixed = f"bs AS (SELECT 'v' || CAST(signal_id AS VARCHAR) AS signal_id, n, x, 7 AS m FROM e UNION ALL SELECT signal_id, n, x, 89 FROM h)"
    cut = f"f AS (SELECT s.signal_id, frame, i, coalesce(x, 0e0) * {hann(16)} AS v FROM (SELECT DISTINCT signal_id, m FROM bs) s CROSS JOIN (SELECT unnest(range(0, 89)) AS frame) CROSS JOIN (SELECT unnest(range(0, 16)) AS i) LEFT JOIN bs x ON x.signal_id = s.signal_id AND x.n = frame * 8 + i AND frame < s.m)"
    q["batch_padded"] = f"WITH {E}, {H}, {mixed}, {cut}, {dft(16)} SELECT signal_id, CAST(frame AS INTEGER) AS frame, CAST(bin AS INTEGER) AS bin, {R('re * re + im * im', 4)} AS value FROM z"
    q["mfcc"], q["mfcc_no_c0"] = mfcc(False), mfcc(True)
    for norm in ("none", "l1", "l2", "max"):
        q[f"chroma_{norm}"] = chroma(norm)
    q["peak_frequency"] = f"""WITH {POWER} SELECT signal_id, CAST(frame AS INTEGER) AS frame, bin, {R("v", 4)} AS value, {R("bin * 250e0", 4)} AS freq_hz
      FROM (SELECT *, row_number() OVER (PARTITION BY signal_id, frame ORDER BY v DESC, bin) AS r FROM p) WHERE r = 1"""
    q["stmtf"] = f"""WITH {POWER}, {mel_bank(8)}, im AS (SELECT signal_id AS image_id, band AS r, frame AS c, sum(w * v) AS v FROM p JOIN fb USING (bin) GROUP BY ALL), {fft2(8, 23)}
SELECT image_id, CAST((r + 4) % 8 AS INTEGER) AS r, CAST((c + 6) % 12 AS INTEGER) AS c, {R("sqrt(re * re + im * im)", 3)} AS v FROM s2"""
    sine = "sin(pi() * (i + 0.5e0) / 64)"
    cosine = "cos(pi() * (((2 * i + 33) * (2 * k + 1)) % 256) / 128e0)"
    m = f"{H}, {frames('h', 64, 32, 0, 720, sine)}, mc AS (SELECT signal_id, frame, k, sum(v * {cosine}) AS v FROM f CROSS JOIN (SELECT unnest(range(0, 32)) AS k) GROUP BY ALL)"
    q["mdct"] = f"WITH {m} SELECT signal_id, CAST(frame AS INTEGER) AS frame, CAST(k AS INTEGER) AS k, {R('v')} AS value FROM mc"
    q["imdct_reconstruct"] = f"WITH {m} SELECT signal_id, n, {R('x')} AS x FROM (SELECT signal_id, frame * 32 + i AS n, sum(v * {cosine} * {sine}) / 16 AS x FROM mc CROSS JOIN (SELECT unnest(range(0, 64)) AS i) GROUP BY ALL) WHERE n < 700"
    taps = "(VALUES (0, 0.5e0), (1, 0.25e0), (2, -0.125e0), (3, 0.0625e0), (4, 0.3125e0)) AS t(tap, h)"
    q["convolve_1d"] = f"WITH {E} SELECT signal_id, CAST(n + tap AS BIGINT) AS n, {R('sum(x * h)')} AS x FROM e CROSS JOIN {taps} GROUP BY signal_id, n + tap"
    q["overlap_save_batch"] = f"WITH {H} SELECT signal_id, CAST(n + tap AS BIGINT) AS n, {R('sum(x * t.h)', 9)} AS x FROM h CROSS JOIN {taps} WHERE n + tap < 720 GROUP BY signal_id, n + tap"
    tap_turn = "2 * pi() * ((k * tap) % 64) / 64e0"
    turn_k = "2 * pi() * ((bin * i) % 64) / 64e0"
    q["deconvolve_1d"] = f"""WITH {LINE}, dz AS (SELECT k AS bin, sum(h * cos({tap_turn})) AS dr, -sum(h * sin({tap_turn})) AS di FROM {taps} CROSS JOIN (SELECT unnest(range(0, 33)) AS k) GROUP BY k),
dq AS (SELECT *, dr * dr + di * di + 0.01e0 * max(dr * dr + di * di) OVER () AS q FROM dz),
qz AS (SELECT signal_id, bin, (re * dr + im * di) / q AS re, (im * dr - re * di) / q AS im FROM z JOIN dq USING (bin))
SELECT signal_id, i AS n, {R(f"sum((CASE WHEN bin IN (0, 32) THEN 1 ELSE 2 END) * (re * cos({turn_k}) - im * sin({turn_k}))) / 64")} AS x FROM qz CROSS JOIN (SELECT unnest(range(0, 60)) AS i) GROUP BY signal_id, i"""
    q["magphase"] = f"WITH {LINE} SELECT {bins}, {R('pow(m, 1.5)')} AS magnitude, {R('CASE WHEN m > 0 THEN re / m ELSE 1e0 END')} AS phase_re, {R('CASE WHEN m > 0 THEN im / m ELSE 0e0 END')} AS phase_im FROM (SELECT *, sqrt(re * re + im * im) AS m FROM z)"
    for name in CUES:
        q[name] = cue(name)
    for name, most, power in (("itd", "0.00088e0", 1), ("ipd", "pi()", 1), ("ild", "24e0", 3), ("ilr", "1e0", 3)):
        q[f"{name}_histogram"] = cue_histogram(name, most, power, False)
        q[f"{name}_histogram_normalized"] = cue_histogram(name, most, power, True)
    back = WRAP.replace("ph", "(-ph)")
    means = f"WITH {STEREO}, mt AS (SELECT pair_id, avg({back} / (2 * pi() * 250 * bin) - {CUES['itd']}) AS v FROM zc GROUP BY pair_id)"
    q["itd_diff"] = f"{means} SELECT pair_id, 0 AS frame, {R('v', 9)} AS value FROM mt"
    q["itd_diff_summary"] = f"{means} SELECT pair_id, {R('abs(v) / 0.00086e0 * 90')} AS degrees, {R('v')} AS median_s FROM mt"
    other = "CASE WHEN lm < rm THEN 1 - lm / rm ELSE rm / lm - 1 END"
    q["ilr_diff"] = f"WITH {STEREO} SELECT pair_id, {R(f'abs(avg({other} - ({CUES['ilr']})))')} AS mean FROM zc GROUP BY pair_id"
    e8, wide = images("e"), images("h")
    q["fft2d"] = f"WITH {e8}, {fft2(8, 8)} SELECT {PIXELS}, {R('re')} AS re, {R('im')} AS im FROM s2"
    q["fft2d_rectangular"] = f"WITH {wide}, {fft2(24, 30)} SELECT {PIXELS}, {R('re', 7)} AS re, {R('im', 7)} AS im FROM s2"
    q["power_2d"] = f"WITH {e8}, {fft2(8, 8)} SELECT {PIXELS}, {R('re * re + im * im')} AS v FROM s2"
    q["magnitude_2d"] = f"WITH {e8}, {fft2(8, 8)} SELECT {PIXELS}, {R('sqrt(re * re + im * im)')} AS v FROM s2"
    q["ifft2d_roundtrip"] = f"WITH {e8} SELECT {PIXELS}, {R('v')} AS v FROM im"
    for name, back in (("fftshift", 0), ("ifftshift", 1)):
        q[f"{name}_2d"] = f"WITH {e8} SELECT image_id, CAST((r + 4) % 8 AS INTEGER) AS r, CAST((c + 4) % 8 AS INTEGER) AS c, {R('v')} AS v FROM im"
        q[f"{name}_2d_odd"] = f"WITH {e8}, {fft2(8, 8)} SELECT image_id, CAST((r + 4) % 8 AS INTEGER) AS r, CAST((c - {2 + back} + 5) % 5 AS INTEGER) AS c, {R('sqrt(re * re + im * im)')} AS v FROM s2"
        q[f"{name}_1d"] = f"WITH {E} SELECT signal_id, CAST((n + 32) % 64 AS BIGINT) AS n, {R('x')} AS x FROM e"
        q[f"{name}_1d_odd"] = f"WITH {LINE} SELECT signal_id, CAST((bin - {16 + back} + 33) % 33 AS BIGINT) AS n, {R('re * re + im * im')} AS x FROM z"
    q["fftfreq"] = f"SELECT CAST(i AS INTEGER) AS i, {R('(CASE WHEN i < 8 THEN i ELSE i - 15 END) / (15 * 0.1e0)', 9)} AS value FROM (SELECT unnest(range(0, 15)) AS i)"
    q["rfftfreq"] = f"SELECT CAST(i AS INTEGER) AS i, {R('i / (15 * 0.1e0)', 9)} AS value FROM (SELECT unnest(range(0, 8)) AS i)"
    g = lambda n, s: f"gk AS (SELECT r, c, g / sum(g) OVER () AS w FROM (SELECT r, c, exp(-(pow(r - {n // 2}, 2) + pow(c - {n // 2}, 2)) / {2 * s * s!r}e0) AS g FROM (SELECT unnest(range(0, {n})) AS r) CROSS JOIN (SELECT unnest(range(0, {n})) AS c)))"
    q["gaussian_kernel"] = f"WITH {g(5, 1.2)} SELECT CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, {R('w', 9)} AS w FROM gk"
    q["convolve_2d"] = f"WITH {e8}, {g(3, 1.0)} SELECT image_id, CAST(y AS INTEGER) AS r, CAST(x AS INTEGER) AS c, {R('sum(v * w)')} AS v FROM (SELECT image_id, (im.r + gk.r - 1 + 8) % 8 AS y, (im.c + gk.c - 1 + 8) % 8 AS x, v, w FROM im CROSS JOIN gk) GROUP BY image_id, y, x"
    low, high, middle = mask(8, 8, 0.8), f"(1 - {mask(8, 8, 0.5)})", f"({mask(8, 8, 1.0)} - {mask(8, 8, 0.4)})"
    for name, m2 in (("lowpass", low), ("highpass", high), ("bandpass", middle)):
        q[name] = f"WITH {filtered('e', 8, 8, m2)} SELECT {PIXELS}, {R('v')} AS v FROM y2"
    q["edges"] = f"WITH {filtered('h', 24, 30, f'(1 - {mask(24, 30, 0.1)})')} SELECT {PIXELS}, {R('v', 7)} AS v FROM y2"
    q["sharpen"] = f"WITH {filtered('h', 24, 30, f'(1 - {mask(24, 30, 0.2)})')} SELECT image_id, CAST(im.r AS INTEGER) AS r, CAST(im.c AS INTEGER) AS c, {R('im.v + 1.5e0 * y2.v', 7)} AS v FROM im JOIN y2 USING (image_id, r, c)"
    fast = f"SELECT signal_id, CAST(i AS INTEGER) AS i, {R('sum(p)')} AS value"
    q["fft_convolve_fast"] = f"WITH {E} {fast} FROM (SELECT signal_id, n + tap AS i, x * h AS p FROM e CROSS JOIN {taps}) GROUP BY signal_id, i"
    q["mdct_fast"] = f"WITH {E} {fast} FROM (SELECT signal_id, fr * 16 + k AS i, x * sin(pi() * (n - fr * 16 + 0.5e0) / 32) * cos(pi() / 64 * (2 * (n - fr * 16) + 17) * (2 * k + 1)) AS p FROM e CROSS JOIN (SELECT unnest(range(0, 3)) AS fr) CROSS JOIN (SELECT unnest(range(0, 16)) AS k) WHERE n - fr * 16 BETWEEN 0 AND 31) GROUP BY signal_id, i"
    three = "(VALUES (-1, 1), (0, 2), (1, 1))"
    q["convolve_2d_fast"] = f"WITH {E} {fast} FROM (SELECT signal_id, ((n // 8 + a.d + 8) % 8) * 8 + (n % 8 + b.d + 8) % 8 AS i, x * a.w * b.w / 16e0 AS p FROM e CROSS JOIN {three} AS a(d, w) CROSS JOIN {three} AS b(d, w)) GROUP BY signal_id, i"
    q["lowpass_fast"] = f"WITH {filtered('e', 8, 8, low)} SELECT image_id AS signal_id, CAST(r * 8 + c AS INTEGER) AS i, {R('v')} AS value FROM y2"
    q["cqt_free"] = f"""WITH {E}, {CQT_KERNEL}, zc AS (SELECT signal_id, kn.bin, sum(x * re) AS re, sum(x * im) AS im FROM e JOIN kn ON e.n = 64 - len + kn.n GROUP BY signal_id, kn.bin)
SELECT signal_id, CAST(bin AS INTEGER) AS i, {R("sqrt(re * re + im * im)")} AS value FROM zc"""
    for name in ("itd", "ipd", "ipd_wrapped", "ild", "ilr", "fft2d", "fft2d_rectangular", "power_2d", "magnitude_2d", "ifft2d_roundtrip", "highpass", "bandpass", "fftshift_2d", "edges", "sharpen", "deconvolve_1d", "stmtf"):
        q[f"{name}_fast"] = q[name]
    q["convolve_2d_gaussian_fast"] = q["convolve_2d"]
    whole = "2 * pi() * ((n * k) % 64) / 64e0"
    for name, sign in (("fft_c2c", 1), ("ifft_c2c", -1)):
        q[name] = f"""WITH {B} SELECT pair_id AS signal_id, CAST(k AS INTEGER) AS bin, {R(f"sum(l * cos(t) + {sign} * r * sin(t))")} AS re, {R(f"sum(r * cos(t) - {sign} * l * sin(t))")} AS im
FROM (SELECT pair_id, k, l, r, {whole} AS t FROM pr CROSS JOIN (SELECT unnest(range(0, 64)) AS k)) GROUP BY pair_id, k"""
    # Minimum phase: cosine sums over the 257 frequencies of 512 points, folded cepstrum, and back.
    freq, quef, side = "(SELECT unnest(range(0, 257)) AS k)", "(SELECT unnest(range(0, 257)) AS c)", "(CASE WHEN k IN (0, 256) THEN 1 ELSE 2 END)"
    turn = lambda a: f"2 * pi() * (({a}) % 512) / 512e0"
    q["minimum_phase"] = f"""WITH {E}, hz AS (SELECT signal_id, k, sum(x * cos({turn("n * k")})) AS re, sum(x * sin({turn("n * k")})) AS im FROM e CROSS JOIN {freq} GROUP BY signal_id, k),
hp AS (SELECT signal_id, k, re * re + im * im AS p, max(re * re + im * im) OVER (PARTITION BY signal_id) AS m FROM hz),
hc AS (SELECT signal_id, c, sum({side} * 0.5e0 * ln(p + CASE WHEN m > 0 THEN m * 1e-20 ELSE 1e-300 END) * cos({turn("k * c")})) / 512 * (CASE WHEN c IN (0, 256) THEN 1 ELSE 2 END) AS v FROM hp CROSS JOIN {quef} GROUP BY signal_id, c),
hg AS (SELECT signal_id, k, sum(v * cos({turn("k * c")})) AS re, -sum(v * sin({turn("k * c")})) AS im FROM hc CROSS JOIN {freq} GROUP BY signal_id, k)
SELECT signal_id, CAST(n AS INTEGER) AS i, {R(f"sum({side} * exp(re) * cos(im + {turn('k * n')})) / 512")} AS value FROM hg CROSS JOIN (SELECT unnest(range(0, 64)) AS n) GROUP BY signal_id, n"""
    # Gammatone: the impulse response of four sections by recursion, then each frame's product with it.
    sections = ", ".join(f"d * (cos(a) + ({o}) * sin(a)) AS z{k}" for k, o in enumerate(("1 + sqrt(2e0)", "-1 - sqrt(2e0)", "sqrt(2e0) - 1", "1 - sqrt(2e0)")))
    size = " * ".join(f"(sqrt(pow(cos(a) - z{k}, 2) + pow(sin(a), 2)) / 16000)" for k in range(4))
    first = ", ".join(f"0e0 AS y{k}, 0e0 AS s{k}, 0e0 AS u{k}" for k in range(4))
    chain = " ".join(f"CROSS JOIN LATERAL (SELECT (1 / 16000e0) * {'g.gain * (CASE WHEN g.n = -1 THEN 1e0 ELSE 0e0 END)' if k == 0 else f'x{k - 1}.y'} + g.s{k} AS y, -(1 / 16000e0) * g.z{k} * {'g.gain * (CASE WHEN g.n = -1 THEN 1e0 ELSE 0e0 END)' if k == 0 else f'x{k - 1}.y'} AS w) x{k}" for k in range(4))
    step = ", ".join(f"x{k}.y AS y{k}, x{k}.w + g.u{k} - g.p0 * x{k}.y AS s{k}, -g.p1 * x{k}.y AS u{k}" for k in range(4))
    q["gammatone_iir"] = f"""WITH RECURSIVE {E}, gc AS (SELECT j, 100e0 + j * 7900e0 / 7 AS fc FROM (SELECT unnest(range(0, 8)) AS j)),
ga AS (SELECT j, 2 * pi() * fc / 16000 AS a, exp(-1.019e0 * 2 * pi() * (fc / 9.26449e0 + 24.7e0) / 16000) AS d FROM gc),
gz AS (SELECT j, a, -2 * cos(a) * d AS p0, d * d AS p1, {sections} FROM ga),
gp AS (SELECT j, p0, p1, z0, z1, z2, z3, pow(sqrt(pow(cos(2 * a) + p0 * cos(a) + p1, 2) + pow(sin(2 * a) + p0 * sin(a), 2)), 4) / ({size}) AS gain FROM gz),
g AS (SELECT j, p0, p1, z0, z1, z2, z3, gain, -1 AS n, {first} FROM gp UNION ALL
  SELECT g.j, g.p0, g.p1, g.z0, g.z1, g.z2, g.z3, g.gain, g.n + 1, {step} FROM g {chain} WHERE g.n < 31),
gf AS (SELECT signal_id, fr, n - fr * 16 AS i, x * (0.5e0 - 0.5e0 * cos(2 * pi() * (n - fr * 16) / 31e0)) AS v FROM e CROSS JOIN (SELECT unnest(range(0, 3)) AS fr) WHERE n - fr * 16 BETWEEN 0 AND 31),
gy AS (SELECT signal_id, fr, j, i + g.n AS o, sum(v * y3) AS y FROM gf JOIN g ON g.n >= 0 AND i + g.n < 32 GROUP BY signal_id, fr, j, o)
SELECT signal_id, CAST(fr * 8 + j AS INTEGER) AS i, {R("sqrt(sum(y * y) / 32)", 8)} AS value FROM gy GROUP BY signal_id, fr, j"""
    q["stream_spectra"] = f"WITH {E}, {frames('e', 16, 8, 0, 64, hann(16))}, {dft(16)} SELECT signal_id, CAST(frame AS BIGINT) AS frame, CAST(bin AS INTEGER) AS bin, {R('re * re + im * im')} AS value FROM z"
    q["stream_filter"] = f"WITH {E} SELECT signal_id, CAST(n + tap AS BIGINT) AS n, {R('sum(x * h)')} AS y FROM e CROSS JOIN {taps} WHERE n + tap < 64 GROUP BY signal_id, n + tap"
    return q
