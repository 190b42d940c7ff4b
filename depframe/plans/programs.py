"""Queries over programs: slices of their outputs and descriptions. Two small programs of our own serve the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depframe.frontend import describe as D
from depframe.frontend import statements as P
from depframe.plans.shapes import distinct_programs, of_all_copies, program_sources, programs
from depframe.session import materialise

TANK = """PROGRAM Tank
VAR_INPUT level : REAL; limit, reserve : REAL; END_VAR
VAR_OUTPUT valve : BOOL; alarm : BOOL; count : INT := 0; END_VAR
VAR i : INT; sum : REAL; END_VAR
sum := 0;
FOR i := 1 TO 10 DO
  sum := sum + level;
END_FOR;
IF sum &gt; limit THEN
  valve := FALSE; (* closed *)
ELSIF sum > reserve THEN
  valve := TRUE;
ELSE
  alarm := TRUE; // too low
END_IF;
count := count + 1;
END_PROGRAM
"""
MIXER = """FUNCTION_BLOCK Mixer
VAR_INPUT start : BOOL; speed : INT; END_VAR
VAR_OUTPUT done : BOOL; END_VAR
VAR state : INT; timer : TON; END_VAR
CASE state OF
1: state := 2;
2: timer(IN := start, PT := T#5s);
END_CASE;
WHILE speed > 0 DO
  speed := speed - 1;
END_WHILE;
done := state = 2;
END_FUNCTION_BLOCK
"""


def sample_programs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("mixer", MIXER), ("tank", TANK)], "program_id string, source string")


def st_slice_demo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of the backward slice of every output of the programs that users' events make."""
    lines, copies = distinct_programs(spark, sf_dir)
    lines = materialise(lines, "programs")
    rows = materialise(P.statements(lines), "statements")
    return of_all_copies(P.slice_code(rows, materialise(P.slices(rows, P.symbols(lines)), "slices")), copies)


def st_describe_demo(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.statements(programs(spark, sf_dir))
    return rows.where(F.col("kind") != "end").select("program_id", F.col("ln").cast("long").alias("ln"), P.sentence(rows).alias("sentence"))


def st_describe_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The programs at all three levels, with a documented block."""
    docs = spark.createDataFrame([("timer", "Delays a rising edge")], "callee string, summary string")
    sources = materialise(program_sources(spark, sf_dir), "programs")
    told = [D.described(sources, level, docs).withColumn("level", F.lit(level)) for level in D.LEVELS]
    return told[0].unionByName(told[1]).unionByName(told[2])


QUERIES = {f.__name__: f for f in (st_slice_demo, st_describe_demo, st_describe_levels)}
ORACLES: dict[str, str] = {}
