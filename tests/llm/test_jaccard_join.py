import random
import re

import numpy as np
import pyarrow as pa
import pytest

from depframe.llm.byte_hashing import PrefixHash
from depframe.llm.jaccard_join import bands, jaccard_classes, shingle_hashes, signatures
from depframe.operators.components import connected_components


def shingles(text, words):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()


def brute(texts, words, num, den):
    sets = [shingles(t, words) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def corpus(seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 9 == 0 else f"W{i}" for i in range(400)]
    texts = [None, "", " \n\t", "one", "ONE", "two words", "two\x0bwords", "a b c d", "A B c d", "a b c d e"]
    for _ in range(12):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([6, 9, 14, 25, 60, 150, 400]))]
        for _ in range(rnd.randint(1, 9)):
            w = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 3, 5, 8])):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            cut = rnd.choice([0, 0, 1, 2, len(w) // 12])
            texts.append(rnd.choice([" ", "\n"]).join(w[cut:]))
    rnd.shuffle(texts)
    return texts


@pytest.mark.parametrize(("words", "num", "den", "seed"), [(4, 85, 100, 1), (5, 80, 100, 2)])
def test_classes_match_brute_force(spark, words, num, den, seed):
    texts = corpus(seed)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n string").repartition(3)
    got = {r["id"]: (r["n"], r["component"]) for r in jaccard_classes(df, words=words, num=num, den=den).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, words, num, den)


def test_similar_sets_share_a_signature():
    rnd = np.random.default_rng(4)
    for size in [1, 2, 5, 6, 7, 8, 9, 12, 17, 25, 40, 77, 150, 400, 1500]:
        for _ in range(40):
            whole = rnd.integers(0, 1 << 63, size * 2 + 4).astype(np.uint64)
            extra = int(rnd.integers(0, size // 5 + 2))
            lost = int(rnd.integers(0, size // 6 + 1))
            a, b = np.unique(whole[:size]), np.unique(whole[lost : size + extra])
            common = len(np.intersect1d(a, b))
            if 100 * common >= 85 * (len(a) + len(b) - common):
                one, two = signatures(a, 85, 100), signatures(b, 85, 100)
                shared = np.intersect1d(one.signatures, two.signatures)
                assert shared.size, (size, lost, extra)
                bands = np.bincount((shared & np.uint64(255)).astype(int))
                for x, y in ((one, two), (two, one)):
                    assert any(bands[4 * tag : 4 * tag + 4].max(initial=0) >= least for tag, least in ((x.band, x.least), (x.band - 1, x.below)) if tag in (y.band, y.band - 1, min(one.band, two.band)))


def test_bands_are_whole():
    family = bands(85, 100, 100_000)
    assert family[0].low == 1 and all(a.high == b.low for a, b in zip(family, family[1:]))


def test_equal_words_hash_alike_in_any_batch():
    data = np.frombuffer(b"abc xabc abc", np.uint8)
    h = PrefixHash(data)(np.array([0, 5, 9, 4]), np.array([3, 8, 12, 8]))
    assert h[0] == h[1] == h[2] != h[3]
    one = list(shingle_hashes(pa.array(["q w e r", "a b c d e"]), 4))
    two = list(shingle_hashes(pa.array([None, "a B c d e", "q\tw  e r"]), 4))
    assert (one[0] == two[2]).all() and (one[1] == two[1]).all() and not len(two[0])


def test_odd_rows(spark):
    long = " ".join(f"k{i}" for i in range(30))
    rows = [(None, long), (7, long), (7, long), (9, None), (3, long + " z"), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((r["id"] or -1, r["n"], r["component"]) for r in jaccard_classes(df).collect())
    assert out == [(-1, 26, None), (3, 27, 3), (5, 0, 5), (7, 26, 3), (7, 26, 3), (9, 0, 9)]
    assert jaccard_classes(df.limit(0)).count() == 0


def test_components(spark):
    rnd = random.Random(8)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)] + [(5, 5), (None, 1)]
    root = {x: x for e in edges if None not in e for x in e}
    for _ in range(200):
        for a, b in edges:
            if a is not None:
                root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == root


def test_a_null_key_takes_no_signatures_from_equal_texts(spark):
    base = [f"w{i}" for i in range(60)]
    near = " ".join(base[:30] + ["other"] + base[31:])
    rows = [(None, " ".join(base)), (1, " ".join(base)), (2, near)]
    out = jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted((r["id"], r["component"]) for r in out if r["id"] is not None) == [(1, 1), (2, 1)]
    assert [r["component"] for r in out if r["id"] is None] == [None]


def test_a_group_about_the_threshold(spark):
    """Edits of one text, some too far from it, with and without the text itself; links among the edits alone must be found."""
    rnd = random.Random(5)
    texts = []
    for there in (True, False):
        base = [f"v{rnd.randrange(3000)}" for _ in range(120)]
        texts += [" ".join(base)] * there
        for _ in range(60):
            w = list(base)
            for _ in range(rnd.randint(1, 9)):
                w[rnd.randrange(len(w))] = f"v{rnd.randrange(3000)}"
            texts.append(" ".join(w[rnd.choice([0, 0, 3]) :]))
            if rnd.random() < 0.4:  # an edit of the edit
                w[rnd.randrange(len(w))] = "other"
                texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["id"]: (r["n"], r["component"]) for r in jaccard_classes(df, words=4, num=85, den=100).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 4, 85, 100)
