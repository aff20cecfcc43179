"""All links of the n-gram join, and the number of each document's."""

import pytest
from pyspark.sql import functions as F

from sonoplan.llm import ngram_join

from .test_text_operators import EDGE, corpus, docs_table, shingle_set


def brute_links(rows):
    sets = [(i, shingle_set(t)) for i, t, _ in rows]
    linked = {i: 0 for i, _ in sets}
    pairs = set()
    for x, (i, s) in enumerate(sets):
        for j, t in sets[:x]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                linked[i] += 1
                linked[j] += 1
                if s != t:
                    pairs.add((min(i, j), max(i, j)))
    return linked, pairs


@pytest.mark.parametrize(("seed", "groups", "copies", "passage", "part"), [(1, 60, [1, 2, 5], 0.3, 1000), (2, 5, [60, 90], 0.5, 16)])
def test_links_equal_brute_force(spark, monkeypatch, seed, groups, copies, passage, part):
    monkeypatch.setattr(ngram_join, "SLICE", part)
    rows = corpus(seed, groups, copies, passage)
    rows += [(len(rows) + k, rows[k][1], "s") for k in range(0, len(rows), 7)] + [(9000, "", "s"), (9001, "x y", "s"), (9002, "X y", "s")]
    links, members = ngram_join.jaccard_links(docs_table(spark, rows))
    linked, pairs = brute_links(rows)
    first = {r.doc_id: r.representative for r in members.collect()}
    found = [(r.a, r.b) for r in links.collect()]
    assert len(found) == len(set(found)) and set(found) == {(a, b) for a, b in pairs if first[a] == a and first[b] == b}
    assert {r.doc_id: r.n_links for r in ngram_join.link_counts(links, members).collect()} == linked and len(pairs) > 20


def test_links_of_edges(spark):
    edge, none = (docs_table(spark, rows).withColumns({c: F.lit(c) for c in ("representative", "n", "a")}) for rows in (EDGE, []))
    out = ngram_join.link_counts(*ngram_join.jaccard_links(edge)).collect()
    assert len(out) == edge.count()
    assert all(r.n_links == 0 and r.representative is None for r in out if r.doc_id is None or not r.n_shingles)
    links, members = ngram_join.jaccard_links(none)
    assert links.count() == 0 and ngram_join.link_counts(links, members).count() == 0
