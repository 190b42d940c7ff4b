"""The corpus pipeline: every stage works on all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depframe.llm.jaccard_join import jaccard_classes
from depframe.llm.packing import pack
from depframe.llm.quality_rules import quality_rules
from depframe.llm.queries import vocabulary
from depframe.llm.secret_scan import masked, secret_scan
from depframe.llm.suffix_dedup import suffix_dedup
from depframe.session import materialise, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The estimates of the quality stage are no SQL, so the pipeline as a whole has no twin.
ORACLE_SQL: str | None = None


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules(docs).where(F.col("quality.kept")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, that of the least key: five-word shingles, similarity of 0.8 or more. Rows of a null key stay."""
    classes = jaccard_classes(docs, words=5, num=80, den=100)
    gone = classes.where("id != component").select(F.col("id").alias("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 100 bytes and more that stand earlier in the corpus; characters stay whole."""
    cut = suffix_dedup(docs.select("doc_id", "text", "lang", "source"), whole_characters=True)
    text = F.col("kept").cast("string")
    return cut.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every found secret masked."""
    scanned = secret_scan(docs.select("doc_id", "text", "lang", "source"))
    text = masked(F.col("text"), F.col("secrets"))
    return scanned.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    packed = pack(docs.select("doc_id", "text"), vocabulary("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", reject_low_quality),
    ("jaccard_join", drop_near_duplicates),
    ("suffix_dedup", cut_repeated_passages),
    ("secret_scan", mask_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
