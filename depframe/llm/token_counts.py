"""Token counts through a digest cache.

Every text is reduced to the SHA-256 of its normalised content; with the digest of the tokenizer's version that
is the key of a stored count. Distinct contents without one are encoded and appended to the cache, a
Parquet table in a shared folder, then all rows are joined to it. Copies are reduced to one row in each task before
the shuffle, so a text that a third of all rows share moves once for each task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from importlib.metadata import version
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depframe.llm.chunked_encoding import encoder

CACHE_SCHEMA = "digest binary, n_tokens long, tokenizer string"


def tokenizer_digest(path: str) -> str:
    """Digest of the tokenizer's file, of the library's version and of the way texts are encoded."""
    h = hashlib.sha256(Path(path).read_bytes())
    h.update(f"|tokenizers {version('tokenizers')}|add_special_tokens=False".encode())
    return h.hexdigest()[:32]


def content_digest(text: Column) -> Column:
    """SHA-256 of the normalised content. The vocabulary names no normaliser, so only null changes, to empty."""
    return F.unhex(F.sha2(F.encode(F.coalesce(text, F.lit("")), "utf-8"), 256))


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [sum(c) for c in encoder(path, "count").encode(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return run


def fill_cache(df: DataFrame, tokenizer_path: str, cache_path: str, text: str = "text") -> None:
    """Append to the cache the counts of those distinct contents of ``df`` that it lacks."""
    spark, key = df.sparkSession, tokenizer_digest(tokenizer_path)
    contents = df.select(content_digest(F.col(text)).alias("digest"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    distinct = contents.groupBy("digest").agg(F.first("text").alias("text"))
    misses = distinct.join(stored_counts(spark, key, cache_path), "digest", "left_anti")
    encoded = misses.mapInArrow(_encode(tokenizer_path), "digest binary, n_tokens long")
    encoded.withColumn("tokenizer", F.lit(key)).write.mode("append").partitionBy("tokenizer").parquet(cache_path)


def stored_counts(spark, key: str, cache_path: str) -> DataFrame:
    """(digest, n_tokens) of the cache for one tokenizer version; two runs that filled it at once may have stored a digest twice."""
    empty = spark.createDataFrame([], CACHE_SCHEMA)
    empty.write.mode("append").partitionBy("tokenizer").parquet(cache_path)
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == key)
    return stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(df: DataFrame, tokenizer_path: str, cache_path: str, text: str = "text", limit: int = 512) -> DataFrame:
    """``df`` with n_bytes, n_tokens and over_limit (n_tokens > ``limit``) of each whole text.

    Null counts as empty: 0 bytes, 0 tokens. Repeated rows stay repeated; an empty table gives an empty table; columns of
    the new names are replaced. Special strings inside texts are handled as the tokenizer's file has it.
    """
    fill_cache(df, tokenizer_path, cache_path, text)
    new = ("n_bytes", "n_tokens", "over_limit")
    # The caller's columns travel as one struct, so none of them can clash with those worked on here.
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns if c not in new or c == text))
    keyed = df.select(row.alias("row"), content_digest(F.col(text)).alias("digest"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"))
    counts = stored_counts(df.sparkSession, tokenizer_digest(tokenizer_path), cache_path)
    return keyed.join(counts, "digest", "left").select("row.*", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
