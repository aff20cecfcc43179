"""The n-gram join where a token that counts as rare is in thousands of documents."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sonoplan.llm import ngram_join
from sonoplan.llm.common import BITMAP, discard


def sharing(n):
    """n texts of several sizes, each with one shingle of all in its prefix, and their numbers of shingles."""
    rng = random.Random(5)
    texts = []
    while len(texts) < n:
        some = [" ".join(["a b c d e", *(f"w{rng.randint(0, 10**9)}" for _ in range(rng.choice([4, 5, 8, 20, 40])))]) for _ in range(4000)]
        common = next(ngram_join.shingle_sets(pa.array(["a b c d e"])))
        for text, own in zip(some, ngram_join.shingle_sets(pa.array(some)), strict=True):
            rare, _ = ngram_join.prefix(own, np.zeros(len(own), bool))
            if common[0] in rare:
                texts.append((text, len(own)))
    return texts[:n]


@pytest.mark.parametrize("n, pairs", [(300, 1 << 8), (5000, ngram_join.PAIRS)])
def test_pairs_of_a_rare_token(spark, monkeypatch, n, pairs):
    monkeypatch.setattr(ngram_join, "PAIRS", pairs)
    texts = sharing(n)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    total = sum(m for _, m in texts)
    runs, paired = ngram_join.index(ngram_join.Wanted(docs, docs.select("doc_id")), bytes(1 << (BITMAP - 3)), total)
    got = ngram_join.rare_candidates(runs, total)
    sizes = Counter(m for _, m in texts)
    want = sum(a * (a - 1) // 2 for a in sizes.values()) + sum(sizes[x] * sizes[y] for x in sizes for y in sizes if x < y and 100 * x >= 80 * y)
    assert paired.isEmpty()
    row = got.selectExpr("sum(c)", "sum(cast(a >= b as int))", "sum(cast(100 * least(sa >> 32, sb >> 32) < 80 * greatest(sa >> 32, sb >> 32) as int))").first()
    assert tuple(row) == (want, 0, 0)
    if n < 1000:
        size = {i: m for i, (_, m) in enumerate(texts)}
        assert {(r.a, r.b) for r in got.collect()} == {(i, j) for j in size for i in range(j) if 100 * min(size[i], size[j]) >= 80 * max(size[i], size[j])}
        assert all(r.sa >> 32 == size[r.a] and r.sb >> 32 == size[r.b] for r in got.collect())
    discard(runs, paired)


def test_bitmap_of_frequent_tokens_widens(spark):
    """Every frequent token is in the bitmap while it has room; beyond it, those of most documents are."""
    n = 1 << (BITMAP - 3)
    frequent = spark.range(n).selectExpr("id * 97 % (1L << 28) as position", "40 + id % 2 * 100 as n")
    bits = np.frombuffer(ngram_join.class_bitmap(frequent), np.uint8)
    width = ngram_join._width(bits)
    assert width == BITMAP + 1
    positions = np.arange(n) * 97 % (1 << ngram_join.WIDEST)
    assert ngram_join.has_bit(bits, positions >> (ngram_join.WIDEST - width)).all()
