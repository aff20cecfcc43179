import duckdb
import pytest

import __spark_entry__ as entry
from sonoplan import oracles
from sonoplan import queries as engine

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ("linear_power", "mel_db_fast", "istft_reconstruct", "itd_histogram", "lowpass", "mdct", "cqt_kernel", "window_kaiser")


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(oracles.oracle_sql()) <= set(engine.queries())


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    a = entry.queries()[name](spark, SF).toPandas()
    b = con.execute(entry.oracle_sql()[name]).fetchdf()[list(a.columns)]
    key = [c for c in a.columns if a[c].dtype.kind != "f"]
    a, b = a.sort_values(key).reset_index(drop=True), b.sort_values(key).reset_index(drop=True)
    assert len(a) == len(b)
    for c in a.columns:
        if a[c].dtype.kind == "f":
            assert ((a[c] - b[c]).abs() <= 1e-4 * (1 + a[c].abs())).all(), c
        else:
            assert a[c].tolist() == b[c].tolist(), c
