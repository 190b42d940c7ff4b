"""Functional blocks of three programs, computed by hand."""

import pytest

from depframe.frontend import functional as A
from depframe.frontend import statements as P
from depframe.operators import blocks as B
from depframe.operators import slices as L
from depframe.operators.reports import StageReport
from depframe.plans.code import USER, _code

TANK = """PROGRAM Tank
VAR_INPUT level : REAL; END_VAR
VAR_OUTPUT valve : BOOL; END_VAR
VAR stage : INT; sum : REAL; unused : INT; END_VAR
sum := level + 1;
IF sum > 3 THEN
valve := TRUE;
ELSE
valve := FALSE;
END_IF;
unused := 7;
END_PROGRAM"""
#: Two stages: an assignment to stage begins the second.
STEPS = """PROGRAM Steps
VAR_OUTPUT out : INT; END_VAR
VAR stage : INT; a : INT; b : INT; END_VAR
a := 1;
b := a + 1;
out := b;
stage := out;
IF stage > 2 THEN
stage := stage + 1;
out := stage;
END_IF;
END_PROGRAM"""
#: Nothing that any rule names.
QUIET = """PROGRAM Quiet
VAR a : INT; END_VAR
a := 1;
END_PROGRAM"""


@pytest.fixture(scope="module")
def found(spark):
    programs = spark.createDataFrame([("tank", TANK), ("steps", STEPS), ("quiet", QUIET)], "program_id string, source string")
    lines = P.statement_lines(programs)
    report = StageReport()
    block, nodes, rows = A.functional_blocks(lines, least=3, most=50, least_stage=3, report=report)
    _stages_are_told(spark, report, block, nodes)
    done = A.completed_blocks(block, nodes, rows, P.symbols(lines)).collect()
    texts = {}
    for r in sorted(block.collect(), key=lambda r: r["ln"]):
        texts.setdefault((r["program_id"], r["block"]), []).append(r["raw"])
    return texts, {(r["program_id"], r["block"]): r for r in done}


def _stages_are_told(spark, report, block, nodes):
    told = {(r["stage"], r["measure"]): r["value"] for r in report.table(spark).collect()}
    assert [s for _, s, _, _ in report.values()] == ["criteria", "slices", "clusters", "blocks", "stage-cut", "size-cut", "cleanup", "meaningful", "dedup"]
    assert told["dedup", "rows"] == block.count() and told["clusters", "rows"] >= nodes.count() > 0
    distinct = {(r["stage"], r["measure"]): r["value"] for r in report.distinct(spark, {"blocks": ["program_id", "block"], "lines": ["program_id", "ln"]}).collect()}
    assert distinct["dedup", "lines"] == block.select("program_id", "ln").distinct().count() and ("criteria", "blocks") not in distinct
    assert distinct["meaningful", "blocks"] <= distinct["cleanup", "blocks"] and distinct["dedup", "blocks"] <= distinct["meaningful", "blocks"]
    kinds = report.top("criteria", "kind").collect()
    assert sum(r["count"] for r in kinds) == told["criteria", "rows"] and [r["count"] for r in kinds] == sorted((r["count"] for r in kinds), reverse=True)


def of(texts, program):
    return sorted("|".join(t) for (p, _), t in texts.items() if p == program)


def test_blocks(found):
    texts, _ = found
    whole = "sum := level + 1;|IF sum > 3 THEN|valve := TRUE;|ELSE|valve := FALSE;|END_IF;"
    # The output's slice and the IF's region end in blocks whose lines overlap by 5 of 6 at least one way: only the larger stays unless under 0.85.
    assert whole in of(texts, "tank") and not any("unused" in t for t in of(texts, "tank"))
    assert of(texts, "quiet") == []
    assert all(len(t) >= 3 for t in texts.values())
    for t in of(texts, "steps"):
        assert t.count("IF stage") == t.count("END_IF;")
    assert any(t.startswith("a := 1;|b := a + 1;|out := b;") for t in of(texts, "steps"))


def test_completed_text(found):
    texts, done = found
    name = next(k for k, t in texts.items() if t[0] == "sum := level + 1;")
    assert done[name]["code"] == (
        "VAR_INPUT\n    level : REAL;\nEND_VAR\nVAR_OUTPUT\n    valve : BOOL;\nEND_VAR\nVAR\n    sum : REAL;\nEND_VAR\n\n(* ===== Functional body from original code ===== *)\n"
        "sum := level + 1;\nIF sum > 3 THEN\nvalve := TRUE;\nELSE\nvalve := FALSE;\nEND_IF;"
    )
    assert done[name]["vars_used"] == ["level", "sum", "valve"] and len(done[name]["line_numbers"]) == 6


def test_edges_of_a_program(spark):
    rows = P.statements(P.statement_lines(spark.createDataFrame([("p", "PROGRAM p\nx := 1;\nWHILE x < 9 DO\nx := x + 1;\nEND_WHILE;\nEND_PROGRAM")], "program_id string, source string")))
    every, cut = P.dependences(rows), P.dependences(rows, self_edges=False)
    pairs = lambda df: {(r["src"], r["dst"], r["etype"]) for r in df.collect()}
    assert pairs(every) - pairs(cut) == {(4, 4, "data")} and (3, 4, "control") in pairs(cut)
    assert {r["etype"]: r["n"] for r in L.edge_counts(cut, ["program_id"]).collect()} == {"data": 3, "control": 1}
    nodes = spark.createDataFrame([("p", 4)], "program_id string, node long")
    assert {(r["pred"], r["etype"], r["var"]) for r in L.predecessors(cut, nodes, ["program_id"], include_var=True).collect()} == {(2, "data", "x"), (3, "control", None)}


@pytest.mark.parametrize("setting", ["true", "false"])
def test_loops_patched_alike_whatever_unions_tell(spark, setting):
    """The plan that once lost rows gives the same ones either way."""
    before = spark.conf.get("spark.sql.unionOutputPartitioning")
    spark.conf.set("spark.sql.unionOutputPartitioning", setting)
    try:
        code = _code(spark, "/root/testdata/sf0.001")
        got = B.patched_loops(code.where("event_id % 5 = 0").select("user_id", "ln"), code, USER)
        seen = got.selectExpr("count(*)", "sum(hash(user_id, ln))").first()
    finally:
        spark.conf.set("spark.sql.unionOutputPartitioning", before)
    test_loops_patched_alike_whatever_unions_tell.seen = getattr(test_loops_patched_alike_whatever_unions_tell, "seen", tuple(seen))
    assert tuple(seen) == test_loops_patched_alike_whatever_unions_tell.seen
