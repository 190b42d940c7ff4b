from pyspark.sql import functions as F

from depframe.frontend import statements as P
from depframe.functions import text as T
from depframe.plans import programs as Q
from depframe.sources.programs import read_policy, read_programs, write_blocks


def test_slices_of_own_programs(spark):
    lines = P.statement_lines(Q.sample_programs(spark))
    rows = P.statements(lines)
    got = {(r["program_id"], r["crit"]): r["code"].split("\n") for r in P.slice_code(rows, P.slices(rows, P.symbols(lines))).collect()}
    assert got["tank", "count"] == ["count := count + 1;"]
    assert got["tank", "alarm"] == ["sum := 0;", "FOR i := 1 TO 10 DO", "sum := sum + level;", "END_FOR;", "IF sum > limit THEN", "ELSE", "alarm := TRUE;", "END_IF;"]
    assert got["tank", "valve"][4:] == ["IF sum > limit THEN", "valve := FALSE;", "ELSIF sum > reserve THEN", "valve := TRUE;", "END_IF;"]
    assert got["mixer", "done"] == ["CASE state OF", "1:", "state := 2;", "END_CASE;", "done := state = 2;"]


def test_symbols_and_calls(spark):
    lines = P.statement_lines(Q.sample_programs(spark))
    names = {(r["program_id"], r["name"]): (r["type"], r["storage"]) for r in P.symbols(lines).collect()}
    assert names["tank", "count"] == ("INT:=0", "VAR_OUTPUT") and names["tank", "reserve"] == ("REAL", "VAR_INPUT")
    calls = [r for r in P.statements(lines).collect() if r["kind"] == "call"]
    assert len(calls) == 1 and calls[0]["def"] is None and "start" in calls[0]["uses"]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "tank.st").write_text(Q.TANK.replace("\n", "\r\n"))
    read = read_programs(spark, str(tmp_path / "in")).collect()
    assert read[0]["program_id"] == "tank" and "sum > limit" in read[0]["source"] and "\r" not in read[0]["source"]
    blocks = spark.createDataFrame([("tank", 2, "b;"), ("tank", 1, "a;")], "program_id string, block_id int, code string")
    write_blocks(blocks, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out" / "program_id=tank").glob("part-*"))
    assert text.index("BLOCK 1") < text.index("BLOCK 2")
    (tmp_path / "p.json").write_text('{"io_output": {"slice": {"use_control": false}}}')
    assert read_policy(spark, str(tmp_path / "p.json")).first()["settings"]["slice"]["use_control"] is False
    (tmp_path / "bad.json").write_text("{")
    assert read_policy(spark, str(tmp_path / "bad.json")).count() == 0


def test_line_functions(spark):
    rows = [("1: x := 2;", False), ("a, b:", True), ("IF(x) THEN", False), ("y := 3; // c: d", False)]
    got = spark.createDataFrame(rows, "raw string, label boolean").select("label", T.is_case_label(F.col("raw")).alias("got")).collect()
    assert all(r["label"] == r["got"] for r in got)
    names = [("x", True), ("1_000", False), ("nan", False), ("TRUE", False), ("16#05", True), ("1e5", False), ("t1", True), ("", False)]
    got = spark.createDataFrame(names, "name string, want boolean").select("want", T.is_variable(F.col("name")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)
    lines = T.split_lines(spark.createDataFrame([(1, "a\r\nb\x0bc\n"), (2, ""), (3, None), (4, "\n\n")], "id int, t string"), "t", ["id"])
    assert [(r["id"], r["ln"], r["raw"]) for r in lines.orderBy("id", "ln").collect()] == [(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (4, 1, ""), (4, 2, "")]


def test_control_of_long_branches(spark):
    """A branch of over a hundred lines holds them all, at edges of stretches too; slices read what was written, not the whole plan again."""
    body = "".join(f"x{i} := {i};\n" for i in range(110))
    lines = P.statement_lines(spark.createDataFrame([("p", f"PROGRAM p\nVAR_OUTPUT x99 : INT; END_VAR\nIF a THEN\n{body}END_IF;\nEND_PROGRAM\n")], "program_id string, source string"))
    rows = P.statements(lines)
    head = rows.where("kind = 'if'").first()["ln"]
    got = sorted(r["dst"] for r in P.dependences(rows).where("etype = 'control'").collect())
    assert got == list(range(head + 1, head + 111))
    assert P.slices(rows, P.symbols(lines))._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 0
