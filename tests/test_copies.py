"""Programs with equal sources are taken once; every one of them has its rows."""

import pytest
from pyspark.sql import functions as F

from depframe.frontend import functional as A
from depframe.frontend import statements as P
from depframe.plans import shapes
from depframe.plans.programs import st_slice_demo

SMALL, STEP = "/root/testdata/sf0.001", 14 * 1000  # what an event stands for goes by its number and its user's modulo 14


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The events of some users three times, and of one user more."""
    path = str(tmp_path_factory.mktemp("copies"))
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    users = [r[0] for r in events.select("user_id").distinct().orderBy("user_id").limit(4).collect()]
    some = events.where(F.col("user_id").isin(users[:3])).withColumn("k", F.explode(F.array(*map(F.lit, range(3)))))
    some = some.withColumns({"event_id": F.col("event_id") + F.col("k") * STEP * 100, "user_id": F.col("user_id") + F.col("k") * STEP}).drop("k")
    some.union(events.where(F.col("user_id") == users[3])).write.parquet(f"{path}/events.parquet")
    return path


def test_equal_programs_once(spark, folder):
    lines, copies = shapes.distinct_programs(spark, folder)
    assert lines.select("program_id").distinct().count() == 4
    assert copies.count() == 10
    spread = shapes.of_all_copies(lines, copies)
    assert sorted(spread.collect()) == sorted(shapes.programs(spark, folder).select(*spread.columns).collect())


@pytest.mark.parametrize("query", [shapes.functional_blocks, shapes.completed_blocks, st_slice_demo])
def test_queries_take_them_once(spark, folder, query, monkeypatch):
    met, found = [], P.statements
    with monkeypatch.context() as m:
        counted = lambda lines: (met.append(lines.select("program_id").distinct().count()), found(lines))[1]
        m.setattr(P, "statements", counted)
        if query is not st_slice_demo:
            # As in functional_blocks, without its forty writes: a block for each program.
            m.setattr(A, "functional_blocks", _one_block)
        rows = query(spark, folder).collect()
    assert met == [4]
    of = {}
    for r in rows:
        of.setdefault(r["program_id"], []).append(tuple(r)[1:])
    assert len(of) == 10
    for one in of:
        assert sorted(of[one]) == sorted(of[one % STEP])


def _one_block(lines):
    rows = P.statements(lines).withColumn("ln", F.col("ln").cast("long"))
    block = rows.select("program_id", F.lit(1).cast("long").alias("block"), "ln", "raw")
    return block, block.select("program_id", "block", F.col("ln").alias("node")), rows


def test_no_copies_no_join(spark):
    assert shapes.distinct_programs(spark, SMALL)[1] is None
