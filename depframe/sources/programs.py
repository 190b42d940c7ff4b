"""Reading Structured Text programs and settings, writing blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depframe.functions.text import unescape_entities

POLICY = "map<string, struct<slice: struct<slice_strategy: string, use_data: boolean, use_control: boolean, var_sensitive: boolean>, post: struct<patch_if: boolean, patch_case: boolean, patch_loop: boolean>>>"


def read_programs(spark: SparkSession, path: str) -> DataFrame:
    """(program_id, source): each file whole, UTF-8, entities and line ends resolved. A missing path is an AnalysisException."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    name = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    return files.select(name.alias("program_id"), unescape_entities(F.col("value")).alias("source"))


def read_policy(spark: SparkSession, path: str) -> DataFrame:
    """(kind, settings) of a policy file; a file that does not parse gives no rows."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", POLICY).alias("m")).where("m is not null")
    return text.select(F.explode("m").alias("kind", "settings")).where("settings is not null")


def write_blocks(blocks: DataFrame, path: str) -> None:
    """(program_id, block_id, code) as text, one folder for each program, each block under a line of its number, in order."""
    lines = blocks.select("program_id", "block_id", F.concat(F.lit("===== BLOCK "), F.col("block_id"), F.lit(" =====\n"), F.col("code"), F.lit("\n")).alias("value"))
    ordered = lines.repartition("program_id").sortWithinPartitions("program_id", "block_id")
    ordered.select("program_id", "value").write.mode("overwrite").partitionBy("program_id").text(path)
