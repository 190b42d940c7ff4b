import hashlib
import math

import numpy as np
import pytest

from depframe.llm import ball_clusters as B


def brute(rows, width, k, rounds, scale=256, seed=2):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    cents = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for step in range(rounds + 1):
        near = [min((dist(v, c), j) for j, c in enumerate(cents)) for _, v in kept]
        if step < rounds:
            for j in range(len(cents)):
                own = [v for (_, v), (_, c) in zip(kept, near, strict=True) if c == j]
                if own:
                    cents[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    total = [sum(d for d, c in near if c == j) for j in range(len(cents))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, c, d, total[c], sum(total), sha[c]) for (i, _), (d, c) in zip(kept, near, strict=True)), key=repr)


def clusters(spark, rows, width, k, rounds):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    return sorted((tuple(r) for r in B.ball_clusters(df, width=width, k=k, rounds=rounds).collect()), key=repr)


@pytest.mark.parametrize("coarse", [True, False])
def test_against_brute_force_with_ties_and_odd_rows(spark, coarse):
    rng = np.random.default_rng(4)
    draw = lambda: [float(x) for x in (rng.integers(-2, 3, 3) if coarse else rng.normal(0, 1, 3).astype(np.float32))]
    rows = [(i, draw()) for i in range(300)]
    rows += [(None, draw()), (None, draw()), (5, draw()), (7, rows[7][1]), (7, rows[7][1])]
    rows += [(900, None), (901, []), (902, [1.0, 2.0]), (903, [1.0, None, 2.0]), (904, [float("nan"), 0.0, 0.0]), (905, [float("inf"), 0.0, 0.0])]
    assert clusters(spark, rows, 3, 12, 5) == brute(rows, 3, 12, 5)


def test_fewer_vectors_than_clusters_and_none(spark):
    rows = [(1, [0.5, 0.25]), (2, [0.5, 0.25])]
    assert clusters(spark, rows, 2, 40, 5) == brute(rows, 2, 40, 5)
    assert clusters(spark, [(1, None)], 2, 4, 5) == []
    assert clusters(spark, [], 2, 4, 1) == []


def test_large_components_are_exact_and_larger_ones_an_error(spark):
    rows = [(i, [float(200_000 + i % 3), -262_144.0 + i % 5]) for i in range(20)]
    assert clusters(spark, rows, 2, 3, 4) == brute(rows, 2, 3, 4)
    with pytest.raises(ArithmeticError):
        clusters(spark, [(1, [300_000.0, 0.0])], 2, 3, 1)


def test_balls_compare_few_and_miss_none():
    rng = np.random.default_rng(1)
    cents = rng.integers(-500, 500, (40, 8))
    vectors = cents[rng.integers(0, 40, 4000)] + rng.integers(-60, 60, (4000, 8))
    want, far = B.Balls(cents).assign(vectors, None)
    last = np.where(rng.random(4000) < 0.9, want, rng.integers(0, 40, 4000)).astype(np.int32)
    radius = np.zeros(40, np.int64)
    np.maximum.at(radius, last, np.array([B.squared(v[None], cents[i])[0] for v, i in zip(vectors, last, strict=True)]))
    got = B.Balls(cents, radius).assign(vectors, last)
    assert (got[0] == want).all() and (got[1] == far).all()
    settled = np.zeros(40, np.int64)
    np.maximum.at(settled, want, far)
    assert sum(len(o) for o in B.Balls(cents, settled).order) < 40 * 39 / 4
