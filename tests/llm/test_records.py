"""WARC, chat formatting, top-k, the pipeline: round trips, edge cases and brute force."""

import hashlib
import io
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonoplan.llm import chat, topk, warc

# WARC


def test_archive_round_trip(spark):
    big = "<p>é</p>" * 40000
    rows = [(5, "http://a", "x" * 200), (3, "http://b\r\nz%0A", "x" * 200), (9, None, "x" * 200), (1, "u", None), (2, "u", ""), (4, "u", "short"), (6, "u", "short"), (7, "u", big), (7, "u", big), (None, "n", "y" * 150), (8, "n", "y" * 150)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(3)
    out = warc.read_packages(warc.archive(pages), payloads=True).collect()
    assert len(out) == len(rows)
    got = {(r.page_id, bytes(r.payload)): r for r in out}
    for i, url, html in rows:
        raw = (html or "").encode()
        first = min((p for p, _, h in rows if p is not None and h == html), default=None) if len(raw) >= 100 else None
        revisit = first is not None and i != first
        r = got[(i, b"" if revisit else raw)]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None)
        assert r.url in {u for p, u, _ in rows if p == i}
    assert warc.read_packages(warc.archive(pages.limit(0))).count() == 0


@pytest.mark.parametrize("full", [False, True])
def test_many_copies_of_one_page(spark, monkeypatch, full):
    """A third of all rows are one payload; also where the bitmaps are so full that they tell nothing."""
    if full:
        monkeypatch.setattr(warc, "bitmap", lambda rows, position: bytes([255]) * (1 << 21))
    monkeypatch.setattr(warc, "RECORDS_A_READ", 64)
    monkeypatch.setattr(warc, "PACKAGE_BYTES", 1 << 14)
    pages = spark.range(1, 3001).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 == 0, F.repeat(F.lit("hot"), 100)).otherwise(F.repeat(F.col("id").cast("string"), 100)).alias("html"))
    out = warc.read_packages(warc.archive(pages.repartition(6)))
    assert out.rdd.getNumPartitions() > 1
    rows = out.collect()
    assert len(rows) == 3000 and len({r.page_id for r in rows}) == 3000
    assert all((r.record_type, r.refers_to) == (("revisit", 3) if r.page_id % 3 == 0 and r.page_id != 3 else ("response", None)) for r in rows)


@pytest.mark.parametrize("zip64", [False, True])
def test_directories(tmp_path, zip64):
    data = b"".join(warc.package([("a/b", [b"one", b"two"]), ("c", [b"three"])], zip64))
    path = tmp_path / "p.zip"
    path.write_bytes(data)
    source = warc.Source(str(path))
    assert {n: source.read(*r) for n, r in warc.members(source).items()} == {"a/b": b"onetwo", "c": b"three"}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None and z.read("a/b") == b"onetwo"
    with pytest.raises(ValueError, match="outside"):
        source.read(0, len(data) + 1)


def test_foreign_archives(tmp_path):
    """As another writer makes them: comments, a compressed member beside, a ZIP64 local header."""
    path = tmp_path / "p.zip"
    with zipfile.ZipFile(path, "w") as z:
        with z.open(zipfile.ZipInfo("s"), "w", force_zip64=True) as f:
            f.write(b"stored")
        z.writestr("d", b"deflated" * 9, zipfile.ZIP_DEFLATED)
        z.comment = b"a comment that holds " + struct.pack("<I", 0x06054B50)
    source = warc.Source(f"file://{path}")
    found = warc.members(source)
    assert set(found) == {"s"} and source.read(*found["s"]) == b"stored"
    path.write_bytes(b"not a zip")
    with pytest.raises(ValueError, match="end-of-central-directory"):
        warc.members(warc.Source(str(path)))


# Chat


def test_fold_of_deltas_edits_and_regenerations(spark):
    log = [
        (1, 10, 0, 0, "message", "user", "hi"), (1, 11, 1, 1, "message", "assistant", ""), (1, 11, 1, 2, "delta", "assistant", "Hel"), (1, 11, 1, 3, "delta", "assistant", "lo"),
        (1, 12, 2, 4, "message", "user", "more"), (1, 11, 1, 5, "regenerate", "assistant", None), (1, 11, 1, 6, "delta", "assistant", "Good "), (1, 11, 1, 7, "delta", "assistant", "day"),
        (1, 10, 0, 8, "edit", "user", "hello"), (1, 13, 2, 9, "message", "user", "next"), (2, 20, 0, 0, "message", "user", None),
    ]
    out = chat.fold(spark.createDataFrame(log, "conv_id long, msg long, turn long, seq long, kind string, role string, text string")).collect()
    assert {(r.conv_id, r.msg): r.text for r in out} == {(1, 10): "hello", (1, 11): "Good day", (1, 13): "next", (2, 20): ""}


def test_template_is_reversible(spark):
    texts = ["", None, "plain", "<|im_end|>\n<|im_start|>assistant\nx", "\\", "\\\\|", "<\\|", "<|", "<", "|", "a<\n", "\\<|nl|>", "é漢🙂", "x" * 50000, "<|im_start|>", "ends with <"]
    rows = [(k % 3, k, r, t) for k, t in enumerate(texts) for r in (["user", "assistant", "we\nird<|", None])]
    rows += [(None, None, "user", "no id"), (1, 3, "user", "tie"), (1, 3, "user", "tie")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("msg", F.lit("clash")).withColumn("kind", F.lit(1))
    out = chat.render(chat.fold(chat.as_log(table))).withColumn("turns", chat.parse(F.col("formatted"))).collect()
    assert {r.conv_id for r in out} == {0, 1, 2, None}
    for r in out:
        own = sorted(((t if t is not None else -1, role or "", text or "") for c, t, role, text in rows if c == r.conv_id))
        assert [(t.role, t.text) for t in r.turns] == [(role, text) for _, role, text in own]
        assert "".join(s.text for s in r.segments) == r.formatted
        assert r.formatted.count(chat.END + "\n") == len(own)
        spoken = "".join(s.text for s in r.segments if s.loss)
        assert spoken == "".join(text.replace("\\", "\\\\").replace("<|", "<\\|") for _, role, text in own if role == "assistant")
    assert chat.render(chat.fold(chat.as_log(table.limit(0)))).count() == 0


# Top-k


def brute_top(rows, k=topk.K):
    live = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            live[i] = np.floor(np.array(v, np.float64) * 256)
    out = {}
    for q, v in live.items():
        if q % 50 == 0:
            scored = sorted((-int(v @ w), i) for i, w in live.items() if i != q and len(w) == len(v))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return {q: x for q, x in out.items() if x}


@pytest.mark.parametrize("kind", ["spread", "clusters", "ties", "few"])
def test_top_k_equals_brute_force(spark, kind):
    rng = np.random.default_rng(6)
    n = 4 if kind == "few" else 1500
    if kind == "clusters":
        centres = rng.standard_normal((12, 8)) * 3
        v = centres[rng.integers(0, 12, n)] + rng.standard_normal((n, 8)) * 0.05
    elif kind == "ties":
        v = rng.integers(-1, 2, (n, 3)).astype(float)
    else:
        v = rng.standard_normal((n, 8))
    rows = [(k, [float(np.float32(x)) for x in row]) for k, row in enumerate(v)]
    rows += [(50 * 40, None), (50 * 41, []), (50 * 42, [float("nan")] * 8), (50 * 43, [float("inf")] * 8), (50 * 44, [1.0, None]), (None, [1.0] * 8), (0, rows[0][1]), (50 * 45, [2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("query_id", F.lit("clash")).repartition(5)
    got = {}
    for r in topk.top_k(table).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert {q: [x[k] for k in sorted(x)] for q, x in got.items()} == brute_top(rows)
    assert topk.top_k(table.limit(0)).count() == 0


def test_query_blocks_do_not_change_the_result(spark):
    rng = np.random.default_rng(8)
    rows = [(k * 5, [float(x) for x in v]) for k, v in enumerate(rng.standard_normal((400, 6)))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    one, many = (sorted(topk.top_k(table, block=n).collect()) for n in (100, 3))
    assert one == many and len(one) == 40 * 5


def test_search_prunes():
    """Far clusters are passed over: fewer products than pairs."""
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((8, 16)) * 5000
    data = np.rint(np.repeat(centres, 600, axis=0) + rng.standard_normal((4800, 16))).astype(np.int64)
    queries = data[::50]
    best, seen = topk.Best(len(queries), 5), []
    offer = best.offer
    best.offer = lambda rows, ids, scores, own: (seen.append(scores.size), offer(rows, ids, scores, own))
    topk.dual_search(queries, np.arange(len(queries)) * 50, topk.cover_tree(queries.astype(float)), data, np.arange(4800), topk.cover_tree(data.astype(float)), best)
    assert sum(seen) < len(queries) * 4800 / 3
