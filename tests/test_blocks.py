"""Hand-computed cases of block and criteria operators; the queries of plans.code hold the rest against SQL."""

from pyspark.sql import functions as F

from depframe.operators import blocks as B
from depframe.operators import criteria as C

KEY = ["p"]
CODE = """IF a
  AND b THEN

ELSE
  x := 1;
END_IF;
IF c THEN
  y := 2;
ELSE
  // nothing
END_IF;
CASE s OF
END_CASE;
REPEAT
  z := z + 1;
UNTIL z > 3
END_REPEAT;
FOR i := 1
  TO 9 DO
  IF d THEN
    w := i;
  END_IF;
END_FOR;""".split("\n")


def lines(spark, code=CODE, only=None):
    rows = [(1, ln, raw) for ln, raw in enumerate(code, 1) if only is None or ln in only]
    return spark.createDataFrame(rows, "p int, ln long, raw string")


def test_half_empty_ifs_fold(spark):
    got = {r["ln"]: r["raw"] for r in B.folded_half_ifs(lines(spark), lines(spark), KEY).collect()}
    assert got[1] == "IF NOT (a   AND b) THEN" and not {2, 4, 9} & got.keys()
    assert got.keys() == set(range(1, len(CODE) + 1)) - {2, 4, 9} and got[7] == "IF c THEN"
    # Without the filled side in the block nothing changes.
    part = {r["ln"]: r["raw"] for r in B.folded_half_ifs(lines(spark, only={1, 2, 4, 6}), lines(spark), KEY).collect()}
    assert part == {n: CODE[n - 1] for n in (1, 2, 4, 6)}


def test_cases_without_labels_go(spark):
    got = {r["ln"] for r in B.without_bare_cases(lines(spark), lines(spark), KEY).collect()}
    assert got == set(range(1, len(CODE) + 1)) - {12, 13}
    assert B.without_bare_cases(lines(spark, only={12, 14}), lines(spark), KEY).count() == 2
    labelled = ["CASE s OF", "1:", "END_CASE;"]
    assert B.without_bare_cases(lines(spark, labelled), lines(spark, labelled), KEY).count() == 3


def test_patches_close_cut_structures(spark):
    hit = lambda *at: lines(spark, only=set(at)).select("p", "ln")
    found = lambda df: {r["ln"] for r in df.collect()}
    assert found(B.patched_loops(hit(15), lines(spark), KEY)) == {14, 15, 16, 17}
    assert found(B.patched_loops(hit(21), lines(spark), KEY)) == {18, 19, 21, 23}
    assert found(B.patched_loops(hit(18), lines(spark), KEY)) == {18}
    branches = B.if_branches(lines(spark), KEY)
    assert found(B.patched_ifs(hit(5), branches, KEY)) == {4, 5, 6}
    assert found(B.patched_ifs(hit(8, 21), branches, KEY)) == {7, 8, 11, 20, 21, 22}
    assert [(r["start"], r["else_ln"], r["end"]) for r in B.same_level_else(lines(spark), KEY).orderBy("start").collect()] == [(1, 4, 6), (7, 9, 11)]


def test_orphans_wrappers_and_balance(spark):
    code = ["ELSE", "IF TRUE THEN", "a;", "ELSE", "b;", "END_IF;", "END_IF", "", " ", "IF c THEN"]
    kept = lambda df: [r["ln"] for r in df.orderBy("ln").collect()]
    assert kept(B.without_orphans(lines(spark, code), KEY)) == [2, 3, 4, 5, 6, 8, 9, 10]
    assert kept(B.without_true_wrappers(lines(spark, code), KEY)) == [3, 5, 8, 9, 10]
    assert kept(B.with_single_blanks(lines(spark, code), KEY)) == [1, 2, 3, 4, 5, 6, 7, 8, 10]
    assert B.if_balance(lines(spark, code), KEY).first()[1:] == (-1, 0, False)


def test_empty_tables(spark):
    none = lines(spark, only=set())
    for df in (B.without_orphans(none, KEY), B.if_branches(none, KEY), B.folded_half_ifs(none, none, KEY), B.without_bare_cases(none, none, KEY)):
        assert df.isEmpty()


def test_state_variables_fall_back_to_all_of_the_class(spark):
    symbols = spark.createDataFrame([(1, "stage", "VAR"), (1, "mode", "VAR"), (1, "x", "VAR"), (2, "step", "VAR")], "p int, name string, storage string")
    facts = spark.createDataFrame([(1, 1, "stage"), (1, 2, "stage"), (1, 3, "mode"), (2, 1, "step")], "p int, node int, name string")
    got = {(r["p"], r["name"]) for r in C.state_variables(symbols, facts, facts, KEY).collect()}
    assert got == {(1, "stage"), (2, "step")}


def test_roots_and_first_parts(spark):
    control = spark.createDataFrame([(1, 1, 2), (1, 1, 3), (1, 3, 4)], "p int, src int, dst int")
    criteria = spark.createDataFrame([(1, 4, "control_region_set", "a", 0), (1, 3, "control_region_set", "b", 1), (1, 2, "control_region_set", "c", 2), (1, 4, "api_call", "d", 3)], "p int, node int, kind string, variable string, ord int")
    got = {(r["node"], r["kind"], r["variable"]) for r in C.root_normalised(criteria, control, KEY, ["ord"]).collect()}
    assert got == {(3, "control_region_set", "a"), (1, "control_region_set", "c"), (4, "api_call", "d")}
    once = C.mined([criteria.drop("ord"), criteria.withColumn("variable", F.lit("d")).drop("ord")], KEY)
    assert {(r["kind"], r["variable"], r["ord"]) for r in once.where("node = 4").collect()} == {("control_region_set", "a", 0), ("api_call", "d", 0), ("control_region_set", "d", 1)}
