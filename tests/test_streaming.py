import numpy as np
import pytest

from sonoplan.errors import DimensionMismatch
from sonoplan.params import StftParams
from sonoplan.plans import vector
from sonoplan.streaming.frames import OverlapSave, filter_stream, spectra_stream


def _run(spark, tmp_path, make, rows, name):
    """The stream's rows over three files, one a micro-batch."""
    source = tmp_path / name
    schema = "signal_id long, n long, x double"
    for k in range(3):
        part = [r for r in rows if k * 37 <= r[1] < (k + 1) * 37]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
    stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source)))
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).toPandas()


def test_streamed_spectra_equal_batch(spark, tmp_path):
    x = np.random.default_rng(1).standard_normal(111)
    p = StftParams(16, 8, centre=False)
    got = _run(spark, tmp_path, lambda s: spectra_stream(s, p), [(1, n, float(v)) for n, v in enumerate(x)], "spectra").sort_values("frame")
    assert got["frame"].tolist() == list(range(p.frame_count(111)))
    assert np.allclose(np.array(got["power"].tolist()), vector.power(vector.framed(x, p)))


def test_streamed_filter_equals_batch(spark, tmp_path):
    x, h = np.random.default_rng(2).standard_normal(111), np.array([0.5, 0.25, -0.5, 0.125])
    got = _run(spark, tmp_path, lambda s: filter_stream(s, h), [(1, n, float(v)) for n, v in enumerate(x)], "filtered").sort_values("n")
    assert np.allclose(got["y"], np.convolve(x, h)[:111])


def test_late_samples_and_gaps(spark, tmp_path):
    """The second file repeats a position of the first and skips some: late ones go if that is asked for, gaps are zeros."""
    x = np.random.default_rng(5).standard_normal(111)
    rows = [(1, n, float(v)) for n, v in enumerate(x) if not 50 <= n < 60] + [(1, 3, 9.0)]
    want = np.where((np.arange(111) >= 50) & (np.arange(111) < 60), 0, x)
    source, schema = tmp_path / "late", "signal_id long, n long, x double"
    for part in ([r for r in rows if r[1] < 45 and r[2] != 9.0], [r for r in rows if r[1] >= 45] + [(1, 3, 9.0)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))

    def run(name, **kw):
        stream = filter_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source)), [1.0, 0.5], **kw)
        q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).toPandas().sort_values("n")

    got = run("dropped", late="drop", expire_s=3600)
    assert got["n"].tolist() == list(range(111)) and np.allclose(got["y"], np.convolve(want, [1.0, 0.5])[:111])
    with pytest.raises(Exception, match="late or twice"):
        run("refused")


def test_overlap_save_blocks():
    x, h = np.random.default_rng(3).standard_normal(1024), np.exp(-np.arange(200) / 40) * np.sin(np.arange(200))
    f = OverlapSave(h, 128)
    y = np.concatenate([f.process_block(x[k : k + 128]) for k in range(0, 1024, 128)])
    assert np.allclose(y, np.convolve(x, h)[:1024])
    f.reset()
    assert np.allclose(f.process_block(x[:128]), y[:128])
    with pytest.raises(DimensionMismatch):
        f.process_block(x[:5])
