"""Every query with a DuckDB twin gives the twin's rows."""

import glob
import os

import duckdb
import pytest

from depframe import plans

SF = "/root/testdata/sf0.001"
#: Their many rounds take long on one machine; the driver compares them too.
SLOW = {"greedy_near_dedup"}


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.ORACLES.keys() - SLOW))
def test_matches_duckdb(spark, con, name):
    df = plans.QUERIES[name](spark, SF)
    want = con.sql(plans.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    columns = sorted(df.columns)
    at = [want.columns.index(c) for c in columns]
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_identifiers_of_later_lines_count(spark, tmp_path):
    rows = [(1, "alpha beta\nbeta gamma TRUE\n\n  _d9 9e"), (2, ""), (3, None), (4, "\nlate"), (5, "1 2")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = {r["doc_id"]: (r["n_names"], r["n_variables"]) for r in plans.QUERIES["document_identifiers"](spark, str(tmp_path)).collect()}
    assert out == {1: (5, 4), 4: (1, 1), 5: (0, 0)}
