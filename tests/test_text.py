from pyspark.sql import functions as F

from depframe.functions import text as T


def flags(spark, lines, of):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(of(F.col("x"))).collect()]


def test_block_comments_go_before_line_comments(spark):
    assert flags(spark, ["x (* // *) y", "  a := 1; // (* b", "(* c *) // d"], T.norm_line) == ["X  Y", "A := 1;", ""]


def test_covered_kinds(spark):
    lines = ["t : STRING(80);", "VARIABLE := 1;", "FUNCTIONS(a);", "VAR_INPUT", "END_IF;", "IF a THEN", "a : INT := 3;", ""]
    assert flags(spark, lines, T.is_covered_kind) == [False, True, True, False, False, True, True, False]


def test_line_predicates(spark):
    lines = ["IF a THEN", "IF(a) THEN", "ELSE", "ELSIF b THEN", "END_IF;"]
    norm = lambda f: lambda c: f(T.norm_line(c))
    assert flags(spark, lines, norm(T.is_if_start)) == [True, False, False, False, False]
    assert flags(spark, lines, norm(T.is_else)) == [False, False, True, False, False]
    assert flags(spark, lines, norm(T.is_elsif)) == [False, False, False, True, False]
    assert flags(spark, lines, norm(T.is_end_if)) == [False, False, False, False, True]


def test_an_empty_sentence_has_no_period(spark):
    assert flags(spark, ["", "a", "b."], T.with_period) == ["", "a.", "b."]
