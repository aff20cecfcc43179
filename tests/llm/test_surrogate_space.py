"""Entities whose surrogates run out, or have nothing to draw anew, do not end the job."""

from sonoplan.llm import pii
from tests.llm.test_text_operators import docs_table


def test_used_up_space_is_enlarged(spark, monkeypatch):
    monkeypatch.setattr(pii, "ATTEMPTS", 2, raising=False)
    monkeypatch.setattr(pii, "MOST_ATTEMPTS", 2, raising=False)
    entities = spark.createDataFrame([("ssn", str(k)) for k in range(10)], "_ki string, _no string")
    out = pii.surrogates(entities).toPandas()
    assert len(out) == 10 and out["_su"].is_unique and not set(out["_su"]) & set(out["_no"])


def test_what_has_nothing_to_redraw(spark, monkeypatch):
    monkeypatch.setattr(pii, "MOST_ATTEMPTS", 2, raising=False)
    rows = [(1, "password: ________ and token = --------", "s"), (2, "Mr. Արամ came", "s"), (3, "token = ____abcd1234", "s")]
    text = {r.doc_id: r.text for r in pii.rewrite(docs_table(spark, rows)).collect()}
    assert text[1] == rows[0][1] and text[2] != rows[1][1] and text[3] != rows[2][1] and text[3].startswith("token = ____")
