import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from depframe.llm.quality_classifier import N_FEATURES, Moments, feature_moments, fit_nnpu, fit_quality, held_out, score_quality, text_features
from depframe.session import table

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = fit_quality(docs, labels)
    scored = score_quality(docs, model).join(labels, "doc_id").withColumn("out", held_out(F.col("doc_id"))).where("out").collect()
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in scored)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in scored)
    y, s = np.array([r["quality"] for r in scored]), np.array([r["score"] for r in scored])
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    assert auc > 0.97 and np.mean((s >= 0.5) == y) > 0.95


def moments(x):
    x = np.c_[x, np.ones(len(x))]
    return Moments(x.T @ x)


def test_risk_recovers_a_hidden_class():
    rnd = np.random.default_rng(1)
    good, bad = rnd.normal(1, 1, (3000, 5)), rnd.normal(-1, 1, (1000, 5))
    model = fit_nnpu(moments(good[:1000]), moments(np.concatenate([good[1000:], bad[:667]])), 0.75)
    assert np.mean(model.score(good) >= 0.5) > 0.93 and np.mean(model.score(bad[667:]) < 0.5) > 0.9


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 9.0), (2, "", 9.0), (None, "a b", 9.0), (1, "x" * 100_000, 9.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (None, 0), (3, None)], "doc_id long, quality int")
    model = fit_quality(df, labels)
    out = score_quality(df, model).collect()
    assert len(out) == 4 and all(0 <= r["score"] <= 1 for r in out)
    assert score_quality(df.limit(0), model).count() == 0
    assert fit_quality(df.limit(0), labels.limit(0)).prior == 0.5
    x = text_features(pa.array(["a b a", None, "a b a", "é!! X"]))
    assert x.shape == (4, N_FEATURES) and (x[0] == x[2]).all() and not x[1].any()


def test_moments_are_those_of_all_rows(spark):
    rows = [(i, f"word{i % 7} and {'!' * (i % 5)} more" * (i % 9)) for i in range(300)] + [(5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    trusted = spark.createDataFrame([(i,) for i in range(0, 300, 3)], "__id long")
    x = text_features(pa.array([t for _, t in rows])).astype(np.float64)
    own = np.array([i % 3 == 0 for i, _ in rows])
    for got, some in zip(feature_moments(df, "doc_id", "text", trusted), (x[own], x), strict=True):
        assert np.allclose(got.second, moments(some).second)
