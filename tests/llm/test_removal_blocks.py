"""Removal of benchmark passages does not depend on how items are dealt to blocks."""

from sonoplan.llm import decontaminate
from tests.llm.test_text_operators import docs_table


def test_removal_does_not_depend_on_blocks(spark, tmp_path, monkeypatch):
    w = [f"v{k}" for k in range(60)]
    spark.createDataFrame([(f"i{k}", " ".join(w[k : k + 10])) for k in range(0, 50, 5)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    between = " ".join(w[20:30])
    rows = [(k, "start " + " ".join(w[5 * k : 5 * k + 25]) + " end", "s") for k in range(7)]
    rows += [(20, " ".join([*w[:5], between, *w[5:10]]) + " kept", "s"), (21, between, "s"), (22, "clean", "s"), (23, None, "s")]
    outs = []
    for items in (decontaminate.BLOCK_ITEMS, 4):
        monkeypatch.setattr(decontaminate.item_blocks, "__defaults__", (items,))
        outs.append({r.doc_id: (r.text, r.n_chars) for r in decontaminate.remove_benchmark(spark, docs_table(spark, rows), str(tmp_path)).collect()})
    assert outs[0] == outs[1] and 21 not in outs[1] and outs[1][22][0] == "clean" and outs[1][23][0] is None
    assert all(outs[1][k][0].split() == ["start", "end"] for k in range(7)) and outs[1][20][0].split() == ["kept"]
