import random
import zlib
from array import array
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from depframe.llm.packing import CAPACITY, pack, plan

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_plan_uses_all_and_fits():
    rnd = random.Random(3)
    for capacity, many in ((64, 500), (2048, 3000), (10, 40), (2048, 1)):
        for _ in range(4):
            counts = Counter(min(capacity, max(1, int(rnd.lognormvariate(3, 1.2)))) for _ in range(many))
            used: Counter = Counter()
            bins = 0
            for pattern, times in plan(counts, capacity):
                assert times > 0 and sum(pattern) <= capacity
                bins += times
                for k in pattern:
                    used[k] += times
            assert used == counts
            assert bins <= 1.03 * sum(k * v for k, v in counts.items()) / capacity + 2


def test_exact_complements_are_found():
    assert sorted(plan({60: 2, 40: 1, 25: 1, 15: 1}, 100)) == [((60, 25, 15), 1), ((60, 40), 1)]
    assert plan({}, 100) == []
    assert plan({50: 10**9}, 100) == [((50, 50), 5 * 10**8)]


@pytest.mark.parametrize("partitions", [1, 3])
def test_pieces_and_places(spark, partitions):
    texts = [None, "", "a", "same words here", "same words here"] + [" ".join(f"w{i * j % 101}" for j in range(i * 13 % 900)) for i in range(60)] + ["long " * 5000]
    df = spark.createDataFrame([(i if i else None, t, "keep", 7) for i, t in enumerate(texts)], "doc_id long, text string, lang string, length int").repartition(partitions)
    out = pack(df, PATH).collect()
    whole, by_doc, bins = Tokenizer.from_file(PATH), defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r["doc_id"] or 0].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        assert r["lang"] == "keep"
    assert len(by_doc) == len(texts)
    for i, t in enumerate(texts):
        ids = whole.encode(t or "", add_special_tokens=False).ids + [0]
        want = [(k, a, len(ids[a : a + CAPACITY]), zlib.crc32(array("I", ids[a : a + CAPACITY]).tobytes())) for k, a in enumerate(range(0, len(ids), CAPACITY))]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc[i]) == want
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= CAPACITY
    assert pack(df.limit(0), PATH).count() == 0


def test_clashing_columns(spark):
    names = ("sequence_id", "offset", "part", "nth", "__text", "piece", "__rank")
    df = spark.createDataFrame([(i, "one two", *range(len(names))) for i in range(5)], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    out = pack(df, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert all([r[n] for n in ("part", "nth", "__text")] == [2, 3, 4] for r in out) and len({(r["sequence_id"], r["offset"]) for r in out}) == 5
