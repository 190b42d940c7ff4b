import random

import pytest

from depframe.llm import suffix_dedup as sd
from depframe.llm.columns import rows_at_a_time


def brute(rows, length):
    seen, out = {}, {}
    for doc, text in sorted(((d, (t or "").encode()) for d, t in rows), key=lambda x: x[0]):
        gone = bytearray(len(text))
        for p in range(len(text) - length + 1):
            w = text[p : p + length]
            if seen.setdefault(w, (doc, p)) != (doc, p):
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(text, gone) if not g)
        out[doc] = (len(text), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), kept)
    return out


def corpus(seed):
    rnd = random.Random(seed)
    words = ["ab", "çé", "the", "q", "zz9", "漢", "longerword", "\n"]
    fresh = lambda n: " ".join(rnd.choice(words) + str(rnd.randrange(1000)) for _ in range(n))
    passages = [fresh(k) for k in (10, 14, 18, 19, 20, 21, 22, 25, 40, 120)]
    line = fresh(17)
    texts = [None, "", "x" * 99, "x" * 100, "x" * 101, "y" * 350, ("ab" * 80) + ("ba" * 70), passages[-1], passages[-1], "\n"]
    for _ in range(70):
        parts = [fresh(rnd.randint(0, 30))]
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            cut = rnd.choice([0, 0, 3, 7])
            parts += [p[cut : len(p) - rnd.choice([0, 0, 2, 9])], fresh(rnd.randint(0, 12))]
        if rnd.random() < 0.5:
            parts.insert(1, line)
        texts.append(" ".join(parts))
    ids = rnd.sample(range(1000), len(texts))
    return list(zip(ids, texts))


@pytest.mark.parametrize(("seed", "batches", "hot"), [(1, 3, 16), (2, 1, 2), (3, 5, 3)])
def test_matches_brute_force(spark, monkeypatch, seed, batches, hot):
    rows = corpus(seed)
    monkeypatch.setattr(sd, "HOT", hot)
    df = spark.createDataFrame([(d, t, 1.5) for d, t in rows], "doc_id long, text string, kept double").repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in sd.suffix_dedup(df, batches=batches).collect()}
    want = brute(rows, 100)
    for d in want:
        assert got[d] == want[d], (d, got[d][:3], want[d][:3])


def test_levels_merge_as_a_counter(spark):
    family, ranks = sd.SuffixLevels(spark), []
    for i in range(6):
        docs = spark.createDataFrame([(i, f"{i} " * 10 + "shared passage " * 12)], "doc long, text string")
        family.add(docs).count()
        ranks.append([r for r, _ in family.levels])
    assert ranks == [[0], [1], [1, 0], [2], [2, 0], [2, 1]]


def test_odd_rows_and_whole_characters(spark):
    long = "é" * 120
    rows = [(None, long), (4, long), (4, long), (2, "short"), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_removed"]) for r in sd.suffix_dedup(df).collect())
    # Within one row 240 bytes of one repeated character: all but its first two bytes' windows repeat.
    assert out == [(-1, 240, 240), (2, 5, 0), (4, 240, 238), (4, 240, 238), (9, 0, 0)]
    odd = spark.createDataFrame([(1, "a" * 50 + "é" + "b" * 99), (2, "é" + "b" * 99)], "doc_id long, text string")
    kept = {r["doc_id"]: bytes(r["kept"]) for r in sd.suffix_dedup(odd, whole_characters=True).collect()}
    assert all(b.decode() is not None for b in kept.values())
    assert sd.suffix_dedup(df.limit(0)).count() == 0


def test_long_text_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(sd, "BLOCK", 300)
    rows = corpus(7)[:40] + [(5000, " ".join(str(i % 331) for i in range(700)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in sd.suffix_dedup(df, batches=2).collect()}
    assert got == brute(rows, 100)


@pytest.mark.parametrize(("held", "crowd", "compared"), [(3, 2, 40), (20, 1000, 1), (1 << 16, 4, 500)])
def test_groups_in_parts(spark, monkeypatch, held, crowd, compared):
    """An anchor that very many texts share, with equal and with different surroundings, in groups cut small."""
    monkeypatch.setattr(sd, "HELD", held)
    monkeypatch.setattr(sd, "CROWD", crowd)
    monkeypatch.setattr(sd, "COMPARED", compared)
    monkeypatch.setattr(sd, "TEXT_ROWS", 4)
    passage = "a passage of over one hundred bytes that stands in very many texts, the same each time, whatever is around it; so it is"
    rows = [(i, f"{i * 7919 % 1000} before {passage} after {i * 104729 % 997}" if i % 3 else passage) for i in range(60)] + corpus(5)[:30]
    rows = list({d: (d, t) for d, t in rows}.values())
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(12)
    with rows_at_a_time(spark, 4):
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in sd.suffix_dedup(df, batches=3).collect()}
    assert got == brute(rows, 100)
