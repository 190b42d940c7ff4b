"""Columns of the caller whose names hold dots or blanks, or clash with inner ones, pass every operator that keeps columns."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from depframe.llm import packing, quality_classifier, sentence_pieces, suffix_dedup
from depframe.llm.queries import vocabulary

NAMES = ["a.b", "c d", "at", "length"]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string").select("*", *(F.lit(n).alias(n) for n in NAMES))


def kept(df, names=NAMES):
    return df.count() and all(r[n] == n for r in df.collect() for n in names)


def test_suffix_dedup(docs):
    assert kept(suffix_dedup.suffix_dedup(docs))


def test_sentence_pieces(docs):
    model = sentence_pieces.PieceModel.load(vocabulary("piece_bpe_32k.model"))
    assert kept(sentence_pieces.digest_columns(docs, model)) and kept(sentence_pieces.encode_column(docs, model))


def test_packing(docs):
    assert kept(packing.pack(docs, vocabulary("word_bpe_49k.json")), ["a.b", "c d", "at"])  # length is a column of the result


def test_quality_classifier(spark, docs):
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    many = docs.crossJoin(spark.range(40)).withColumn("doc_id", F.col("id"))
    model = quality_classifier.fit_quality(many.select("doc_id", "text"), labels.crossJoin(spark.range(40)).select("id", "quality").withColumnRenamed("id", "doc_id").distinct())
    assert kept(quality_classifier.score_quality(docs, model))


def test_models_of_equal_size_stay_apart():
    a = sentence_pieces.PieceModel.load(vocabulary("piece_bpe_32k.model"))
    b = dataclasses.replace(a, scores=a.scores - 1)
    assert a.digest != b.digest and sentence_pieces._local(a) is a and sentence_pieces._local(b) is b
