"""Rows on their way through Python workers: the caller's columns under names of our own, as names with dots do not pass ``mapInArrow``, and the size of batches."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def inner(names: list[str]) -> list[str]:
    return [f"__c{i}" for i in range(len(names))]


def carried(names: list[str]) -> list[Column]:
    """The columns ``names``, renamed to ``inner(names)``; ``toDF`` gives them their names back."""
    return [F.col(f"`{n}`").alias(c) for n, c in zip(names, inner(names), strict=True)]


def fields(df: DataFrame) -> list[str]:
    """Names and types of all columns, as a schema text has them."""
    return [f"`{n}` {t}" for n, t in df.dtypes]


@contextmanager
def rows_at_a_time(spark: SparkSession, n: int) -> Iterator[None]:
    """Python workers that are started inside get batches of ``n`` rows, as these rows are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)
