"""The pipeline on the small tables, stage by stage."""

import re

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages(spark):
    from sonoplan.llm.common import stash

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen, kept = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        kept = stash(stage(spark, kept, SF), name)
        seen[name] = kept
        if name != "mixing":
            assert kept.columns == docs.columns
    before = docs.count()
    # Quality: labels agree.
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    judged = labels.join(seen["quality"].select("doc_id", F.lit(1).alias("kept")), "doc_id", "left").toPandas()
    assert ((judged["kept"] == 1) == (judged["quality"] == 1)).mean() > 0.93 and seen["quality"].count() < before
    # Near duplicates: no two left link.
    from tests.llm.test_text_operators import brute_components

    rows = [(r.doc_id, r.text, "") for r in seen["near_duplicates"].collect()]
    assert all(a == b for a, b in brute_components(rows).items())
    # Benchmark passages and personal data are gone.
    from sonoplan.llm.decontaminate import contamination

    assert contamination(seen["decontamination"], spark.read.parquet(f"{SF}/benchmark.parquet")).where("size(spans) > 0").count() == 0
    old = {r.doc_id: r.text for r in seen["decontamination"].collect()}
    mail = re.compile(r"[\w.]+@mail\d\.example\.com")
    for r in seen["personal_data"].collect():
        assert not mail.search(r.text) and (r.text == old[r.doc_id]) == (not re.search(r"@|\d{3}[-.]\d|\d{16}|(?i:password|token) ?=", old[r.doc_id]))
    assert set(r.doc_id for r in seen["mixing"].collect()) == set(old) and seen["mixing"].agg(F.min("repeats")).first()[0] >= 1
