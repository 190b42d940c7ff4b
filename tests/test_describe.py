"""Hand-computed descriptions."""

from depframe.frontend import describe as D

DEEP = """PROGRAM Deep
IF a THEN
  IF b THEN
    IF c THEN
      x := 1;
    END_IF;
    y := USHLW(v, 2);
  END_IF;
  p := 1; q := 2;
END_IF;
WHILE w DO
END_WHILE;
REPEAT
  fb(IN := k, Q => r, 7);
UNTIL r
END_REPEAT;
CASE s OF
1, 2: z := MAX(a, MIN(b, c));
ELSE
  z := 0;
END_CASE;
FOR i := 1 TO n BY 2 DO
  e := 1;
END_FOR;
END_PROGRAM
"""


def told(spark, level, docs=None, source=DEEP, **limits):
    programs = spark.createDataFrame([("d", source)], "program_id string, source string")
    return [r["text"] for r in D.described(programs, level, docs, **limits).orderBy("nth").collect()]


def test_medium(spark):
    assert told(spark, "MEDIUM") == [
        "POU Deep.", "IF a THEN.", "THEN actions: if(...); if(...); ...; USHLW; assign p; .", "END_IF.", "WHILE w DO.", "LOOP actions:", "END_WHILE.",
        "REPEAT.", "LOOP actions: fb.", "UNTIL r.", "END_REPEAT.", "CASE s OF.", "WHEN 1, 2: actions: MAX.", "ELSE actions: assign z.", "END_CASE.",
        "FOR i = 1 TO n BY 2 DO.", "LOOP actions: assign e.", "END_FOR.", "END_POU Deep.",
    ]


def test_fine_with_documents(spark):
    docs = spark.createDataFrame([("fb", "Holds a value")], "callee string, summary string")
    got = told(spark, "FINE", docs)
    assert got[1:12] == [
        "IF a THEN.", "THEN actions:", "  IF b THEN.", "  THEN actions:", "    IF c THEN.", "    THEN actions:", "      Assign x = 1.", "    END_IF.",
        "    Call function: y <- USHLW(<pos>=v(in), <pos>=2(in)).", "    Semantics: Logical left shift: y = v << 2.", "  END_IF.",
    ]
    assert got[15:24] == [
        "WHILE w DO.", "LOOP actions:", "  <empty>.", "END_WHILE.", "REPEAT.", "LOOP actions:", "  Call FB: r <- fb(IN=k(in), Q=r(out), <pos>=7(in)).", "  Semantics: Holds a value.", "UNTIL r.",
    ]
    assert "  Call function: z <- MAX(<pos>=a(in), <pos>=MIN(b, c)(in))." in got


def test_fine_folds_deep_and_long_bodies(spark):
    got = told(spark, "FINE", max_depth=2)
    assert got[1:6] == ["IF a THEN.", "THEN actions:", "  IF b THEN.", "  THEN actions:", "    ."] and got[6] == "  END_IF."
    got = told(spark, "FINE", max_statements=1)
    assert got[1:5] == ["IF a THEN.", "THEN actions:", "  IF b THEN.", "  THEN actions:"] and got[5:9] == ["    IF c THEN.", "    THEN actions:", "      Assign x = 1.", "    END_IF."]
    assert got[9:13] == ["    .", "  END_IF.", "  .", "END_IF."]


def test_coarse_and_empty(spark):
    assert told(spark, "COARSE")[1:3] == ["IF a THEN.", "END_IF."]
    assert told(spark, "COARSE", source="PROGRAM P\nEND_PROGRAM\n") == ["POU P.", "END_POU P."]
    assert told(spark, "COARSE", source="") == []


def test_programs_may_be_numbered(spark):
    """A program without a name is called by its number; one with a name beside it does not make that a number."""
    programs = spark.createDataFrame([(7, "PROGRAM p\nx := 1;\nEND_PROGRAM\n"), (8, "x := 1;\n")], "program_id long, source string")
    told = {(r["program_id"], r["text"]) for r in D.described(programs, "COARSE").collect()}
    assert (7, "POU p.") in told and {p for p, t in told if t.startswith("POU")} == {7, 8}
