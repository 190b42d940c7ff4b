"""Quality classifier by positive-unlabelled learning.

A linear score of text features is fitted by the non-negative unbiased risk: with trusted positives P, unlabelled web text U
and class prior pi, the risk is pi R_P(+) + max(0, R_U(-) - pi R_P(-)), squared loss (1 - z)^2 / 4 of the margin z. When the second part falls below
zero, a step climbs it again in place of descending. The prior is estimated from the labels that learning may see.

With this loss both risks are quadratic in the weights, so they hang on the rows by the first and second moments of their
features alone. Those are summed over the trusted positives and all unlabelled documents in one pass of Spark tasks. Only labelled rows
are bounded: at most ``max_positive`` positives, chosen by a hash of the key, so that their keys can be broadcast and no text is shuffled. The driver
gets two matrices of the number of features, whatever the size of the corpus, and every step on them is a step over all rows.

Features are counts over the whole text: byte frequencies, and word statistics that show repetition, tables and
shouting. They never include labels, lang, source or the key. Scoring runs over Arrow batches of all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depframe.llm.byte_hashing import PrefixHash, slices, text_bytes
from depframe.llm.columns import carried, fields, inner

WORD_FEATURES = 12
N_FEATURES = 256 + WORD_FEATURES
MAX_POSITIVE = 20_000
#: Margins lie about -1 and 1; the score is their logistic at this steepness.
STEEPNESS = 4.0
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def text_features(column: pa.Array) -> np.ndarray:
    """One row of features for each text; null and empty texts have zeros."""
    data, offsets = text_bytes(column)
    out = np.zeros((len(column), N_FEATURES), np.float32)
    for lo, hi in slices(offsets):
        at = offsets[lo : hi + 1] - offsets[lo]
        part, n, lengths = data[offsets[lo] : offsets[hi]], hi - lo, np.diff(at)
        owner = np.repeat(np.arange(n), lengths)
        counts = np.bincount(owner * 256 + part, minlength=n * 256).reshape(n, 256)
        out[lo:hi, :256] = np.sqrt(counts / np.maximum(1, lengths)[:, None])
        word, edge = ~_SPACE[part], np.zeros(len(part) + 1, bool)
        edge[at] = True
        starts = np.flatnonzero(word & (edge[:-1] | ~np.r_[False, word[:-1]]))
        ends = np.flatnonzero(word & (edge[1:] | ~np.r_[word[1:], False])) + 1
        whose = owner[starts]
        words = np.bincount(whose, minlength=n)
        per = lambda mask: np.bincount(whose, mask, n) / np.maximum(1, words)
        total = lambda mask: np.r_[0, np.cumsum(mask)]
        inside = lambda mask: (lambda t: t[ends] - t[starts])(total(mask))
        size, letters, upper, digits = ends - starts, inside(_LETTER[part]), inside(_UPPER[part]), inside(_DIGIT[part])
        with np.errstate(over="ignore"):
            hashes = PrefixHash(part)(starts, ends)
        same = lambda k: np.r_[np.zeros(min(k, len(hashes)), bool), (hashes[k:] == hashes[:-k]) & (whose[k:] == whose[:-k])]
        order = np.lexsort((hashes, whose))
        first = np.r_[True, (hashes[order][1:] != hashes[order][:-1]) | (whose[order][1:] != whose[order][:-1])][: len(order)]
        distinct = np.bincount(whose[order], first, n)
        lines = counts[:, 10] + 1
        columns = (
            np.log1p(words), per(size), per(size > 20), per(letters == 0), per((upper > 1) & (upper * 2 >= letters)), per(digits > 0),
            per(same(1)), per(same(2)), distinct / np.maximum(1, words), np.log1p(words / lines), per(size - letters - digits > 1),
            per((size - letters - digits) * 3 >= size),
        )
        out[lo:hi, 256:] = np.stack(columns, 1)
        out[lo:hi][words == 0] = 0
    return out


@dataclass
class LinearModel:
    """Score = logistic of (features - mean) / scale times weights plus bias."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weights + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(STEEPNESS * self.raw(x), -30, 30)))


@dataclass
class Moments:
    """Number of rows, sum of their features and sum of the outer products, a 1 put behind the features."""

    second: np.ndarray

    @property
    def n(self) -> float:
        return float(self.second[-1, -1])

    def standardised(self, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
        """Mean outer product of ((features - mean) / scale, 1)."""
        change = np.eye(len(mean) + 1)
        change[:-1, :-1] = np.diag(1 / scale)
        change[:-1, -1] = -mean / scale
        return change @ (self.second / max(1.0, self.n)) @ change.T


def fit_nnpu(positive: Moments, unlabelled: Moments, prior: float, rounds: int = 400, rate: float = 0.02, decay: float = 1e-3) -> LinearModel:
    """The model of least non-negative risk, by Adam over exact gradients; without positives or unlabelled rows every score is about the prior."""
    base = unlabelled if unlabelled.n else positive
    n = max(1.0, base.n)
    mean = base.second[:-1, -1] / n
    scale = np.maximum(np.sqrt(np.maximum(np.diag(base.second)[:-1] / n - mean**2, 0)), 1e-3)
    model = LinearModel(mean, scale, np.zeros(len(mean)), float(np.log(prior / (1 - prior))) / STEEPNESS, prior)
    if not positive.n or not unlabelled.n:
        return model
    p, u = positive.standardised(mean, scale), unlabelled.standardised(mean, scale)
    w, m, v = np.zeros(len(p)), 0.0, 0.0
    # With G the mean outer product and g its last column, the mean of (1 -+ z)^2 / 4 is (1 -+ 2 g w + w G w) / 4.
    risk = lambda g, sign: (1 - sign * 2 * g[-1] @ w + w @ g @ w) / 4
    slope = lambda g, sign: (g @ w - sign * g[-1]) / 2
    for t in range(1, rounds + 1):
        negative = slope(u, -1) - prior * slope(p, -1)
        gradient = prior * slope(p, 1) + negative if risk(u, -1) >= prior * risk(p, -1) else -negative
        gradient = gradient + decay * np.r_[w[:-1], 0]
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    model.weights, model.bias = w[:-1], float(w[-1])
    return model


def held_out(key: Column) -> Column:
    """crc32 of the key as text, modulo 3, is 1; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def feature_moments(docs: DataFrame, key: str, text: str, trusted: DataFrame) -> tuple[Moments, Moments]:
    """Moments of the trusted documents (keys ``__id``, of a bounded number) and of all documents, each row once.

    A task sums its rows into one matrix for each kind, sent line by line, and Spark sums the tasks' lines.
    """
    rows = docs.select(F.col(key).alias("__id"), F.col(text).cast("string").alias("text"))
    rows = rows.join(F.broadcast(trusted.select("__id", F.lit(True).alias("trusted"))), "__id", "left").select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    size = N_FEATURES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size, size))
        for batch in batches:
            x = np.c_[text_features(batch.column("text")).astype(np.float64), np.ones(batch.num_rows)]
            own = x[batch.column("trusted").to_numpy(zero_copy_only=False).astype(bool)]
            total += np.stack([own.T @ own, x.T @ x])
        if total[1, -1, -1]:
            kind, line = np.divmod(np.arange(2 * size), size)
            yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(line.astype(np.int32)), pa.array(list(total.reshape(-1, size)), pa.list_(pa.float64()))], ["kind", "line", "x"])

    lines = rows.mapInArrow(run, "kind int, line int, x array<double>")
    summed = lines.groupBy("kind", "line").agg(*(F.sum(F.get("x", i)).alias(f"x{i}") for i in range(size)))
    out = np.zeros((2, size, size))
    for r in summed.toArrow().to_batches():
        x = np.stack([c.to_numpy(zero_copy_only=False) for c in r.columns[2:]], 1) if r.num_rows else np.zeros((0, size))
        out[r.column(0).to_numpy(), r.column(1).to_numpy()] = x
    return Moments(out[0]), Moments(out[1])


def fit_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_positive: int = MAX_POSITIVE) -> LinearModel:
    """Fit on all documents that are not held out and at most ``max_positive`` of those labelled 1. Labels other than 1 serve for the class prior alone; null labels for nothing, nor do null keys."""
    seen = labels.where(~held_out(F.col(key)) & F.col(label).isNotNull())
    share = seen.agg(F.avg((F.col(label) == 1).cast("double"))).first()[0]
    prior = min(0.99, max(0.01, share if share is not None else 0.5))
    trusted = seen.where(F.col(label) == 1).select(F.col(key).alias("__id")).where("__id is not null").distinct()
    trusted = trusted.orderBy(F.xxhash64("__id"), "__id").limit(max_positive)
    open_to_learning = docs.where(~held_out(F.col(key)) & F.col(key).isNotNull())
    return fit_nnpu(*feature_moments(open_to_learning, key, text, trusted), prior)


def score_quality(docs: DataFrame, model: LinearModel, text: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if score >= 0.5). Null texts count as empty, which score like any text of zero features.

    Equal texts score alike; repeated rows stay repeated; an empty table gives an empty table; columns of the new names are replaced.
    """
    keep = [c for c in docs.columns if c not in ("score", "predicted", "__text")]
    rows = docs.select(*carried(keep), F.col(text).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(text_features(batch.column("__text")))
            made = {c: batch.column(c) for c in inner(keep)}
            yield pa.RecordBatch.from_pydict(made | {"score": pa.array(score, pa.float64()), "predicted": pa.array((score >= 0.5).astype(np.int32))})

    return rows.mapInArrow(run, ", ".join(fields(rows.drop("__text")) + ["score double", "predicted int"])).toDF(*keep, "score", "predicted")
