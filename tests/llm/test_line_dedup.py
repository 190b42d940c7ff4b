import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from depframe.llm import line_dedup as L
from depframe.llm.queries import QUERIES

BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least):
    """Every document (id, text) apart; {(id, text): (n_lines, n_dropped, kept)}."""
    key = lambda line: line.strip(BLANK).translate(LOWER)
    found = defaultdict(set)
    docs = {(i, t or "") for i, t in rows}
    for doc in docs:
        for line in doc[1].split("\n"):
            found[key(line)].add(doc)
    often = {k for k, v in found.items() if k and len(v) >= least}
    out = {}
    for doc in docs:
        lines = doc[1].split("\n")
        kept = [x for x in lines if key(x) not in often]
        out[doc] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def cut(spark, rows, least=3):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {(r["doc_id"], r["text"] or ""): tuple(r["lines"]) for r in L.line_dedup(df, least=least).collect()}


def test_against_brute_force(spark):
    rows = [(i, "\n".join(["Same line", f"own {i}", " \t", "É same", "é SAME"][(i + j) % 5] for j in range(i % 7))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "  SAME LINE\r\nsame line\x0b"), (None, "same line\nx"), (None, "other"), (7, "a second text of one id\nSame line")]
    rows += [(104, "rare\nsame line"), (104, "rare\nsame line"), (104, "rare\nsame line"), (105, "rare")]
    assert cut(spark, rows) == brute(rows, 3)


def test_repeated_rows_count_once_and_stay(spark):
    df = spark.createDataFrame([(1, "x\ny")] * 5 + [(2, "x")], "doc_id long, text string")
    got = L.line_dedup(df, least=3).collect()
    assert len(got) == 6 and all(r["lines"]["n_dropped"] == 0 for r in got)


def test_long_document_and_bitmap_words(spark):
    often = [(i, "gone") for i in range(3)]
    text = "\n".join("gone" if i in (5, 64 * 40, 64 * 40 + 63, 9000) else f"line {i}" for i in range(10_000))
    rows = [*often, (9, text)]
    assert cut(spark, rows) == brute(rows, 3)
    maps = {r["id"]: r for r in L.keep_bitmaps(spark.createDataFrame(rows, "doc_id long, text string"), least=3).collect()}
    assert [w["full"] for w in maps[9]["keep"]] == [0, 39, 99] and maps[9]["n_dropped"] == 4
    assert set(maps) == {0, 1, 2, 9}


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert L.line_dedup(empty).count() == 0
    names = ["h1", "id", "digest", "t", "keep", "pos", "row", "a.b", "lines", "first"]
    df = spark.createDataFrame([(i, "x\nown") for i in range(12)], "doc_id long, text string").select("*", *(F.lit(n).alias(n) for n in names))
    got = L.line_dedup(df)
    assert got.columns == ["doc_id", "text", *(n for n in names if n != "lines"), "lines"]
    assert all(r["lines"]["kept"] == "" and r["a.b"] == "a.b" and r["h1"] == "h1" for r in got.collect())


@pytest.mark.parametrize("heavy", [1, 10**9])
def test_heavy_hashes_change_no_result(spark, monkeypatch, heavy):
    monkeypatch.setattr(L, "HEAVY", heavy)
    rows = [(i, f"everywhere\nsome {i % 4}\nown {i}") for i in range(30)]
    assert cut(spark, rows, 5) == brute(rows, 5)


def test_query_as_registered(spark, tmp_path):
    rows = [(i, f"License X\nown {i}\n license x ") for i in range(9)] + [(9, "LICENSE X"), (10, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {d: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for (d, _), (n, gone, kept) in brute(rows, 10).items()}
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in QUERIES["op11_line_dedup"](spark, str(tmp_path)).collect()} == want


def test_range_partitions_serve_the_window(spark):
    """One exchange by range and none after it, so a hot hash is never gathered."""
    rows = L.line_rows(spark.createDataFrame([(1, "a")], "doc_id long, text string"), "doc_id", "text")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning" in plan
