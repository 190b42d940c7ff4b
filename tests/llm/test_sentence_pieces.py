import random
from itertools import product

import public_tokenizers
import sentencepiece

from depframe.llm.sentence_pieces import BYTE, CONTROL, MARK, NORMAL, UNKNOWN, PieceModel, _fields, decode_column, digest_columns, double_array, encode_column

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "a", "Hello world", "  two  blanks ", "line\nbreak\n\n x", "été 漢字 \U0001f600 ß", "tab\tand  ", "don't STOP!! ###", "x" * 300, "\x00\x7f"]


def unigram_file(tmp_path):
    """The same pieces and scores in a file that names the unigram algorithm (trainer_spec.model_type = 1)."""
    data, out = open(PATH, "rb").read(), b""

    def varint(n):
        s = b""
        while n > 127:
            s += bytes([n & 127 | 128])
            n >>= 7
        return s + bytes([n])

    for number, value in _fields(data):
        if number == 2:
            at, kept = 0, b""
            body = value
            spans = []
            while at < len(body):
                start = at
                tag = 0
                shift = 0
                while True:
                    b = body[at]
                    at += 1
                    tag |= (b & 127) << shift
                    shift += 7
                    if b < 128:
                        break
                if tag & 7 == 0:
                    while body[at] > 127:
                        at += 1
                    at += 1
                elif tag & 7 == 2:
                    n = shift = 0
                    while True:
                        b = body[at]
                        at += 1
                        n |= (b & 127) << shift
                        shift += 7
                        if b < 128:
                            break
                    at += n
                else:
                    at += 4 if tag & 7 == 5 else 8
                spans.append((tag >> 3, body[start:at]))
            kept = b"".join(x for n, x in spans if n != 3) + b"\x18\x01"
            value = kept
        out += varint(number << 3 | 2) + varint(len(value)) + value
    path = tmp_path / "unigram.model"
    path.write_bytes(out)
    return str(path)


def test_ids_match_the_library(tmp_path):
    library = sentencepiece.SentencePieceProcessor(model_file=unigram_file(tmp_path))
    model = PieceModel.load(PATH)
    rnd = random.Random(2)
    letters = "aeiou tnsrhé\n漢1.,  "
    texts = TEXTS[1:] + ["".join(rnd.choice(letters) for _ in range(rnd.randrange(60))) for _ in range(300)]
    differ = 0
    for t in texts:  # the library now and then takes a path of lower score; never a higher one
        own, other = model.encode(t).tolist(), library.encode(t)
        differ += own != other
        unknown = [sum(model.kinds[i] == BYTE for i in ids) for ids in (own, other)]
        assert own == other or (unknown[0] == unknown[1] and sum(model.scores[i] for i in own) > sum(model.scores[i] for i in other)), repr(t)
    assert differ <= len(texts) // 100


def test_round_trip(spark):
    model = PieceModel.load(PATH)
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids int").repartition(2)
    out = decode_column(encode_column(df, model), model).collect()
    assert len(out) == len(TEXTS)
    for r in out:
        assert r["decoded"] == (TEXTS[r["doc_id"]] or "")
    assert encode_column(df.limit(0), model).count() == 0


def test_a_chunk_may_be_any_word(spark):
    model = PieceModel.load(PATH)
    texts = ["x\nlists of y", "lists", "x\nlists\nlists of"]
    assert [model.decode(model.encode(t)) for t in texts] == texts
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    fresh = PieceModel.load(PATH)
    fresh.name = "fresh"
    assert {r["doc_id"]: r["decoded"] for r in decode_column(encode_column(df, fresh), fresh).collect()} == dict(enumerate(texts))


def test_best_path_is_the_best():
    pieces = ["<unk>", "<s>", *(f"<0x{b:02X}>" for b in range(256)), MARK, "a", "b", "ab", "aba", MARK + "a", "bb", "ba", "c"]
    kinds = [UNKNOWN, CONTROL, *[BYTE] * 256, *[NORMAL] * 9]
    scores = [0.0] * 258 + [-2.0, -3.0, -3.5, -4.0, -6.25, -3.0, -5.0, -4.5, -9.0]
    model = PieceModel.build(pieces, scores, kinds)
    words = {p: s for p, s, k in zip(pieces, scores, kinds) if k == NORMAL}

    def best(text):
        if not text:
            return 0.0
        found = [s + best(text[len(p) :]) for p, s in words.items() if text.startswith(p)]
        return max(found, default=-1e9)

    for n in range(1, 6):
        for letters in product("ab ", repeat=n):
            text = "".join(letters)
            ids = model.encode(text)
            assert model.decode(ids) == text
            assert abs(sum(scores[i] for i in ids) - best(MARK + text.replace(" ", MARK))) < 1e-9
    assert model.decode(model.encode("aéz")) == "aéz"


def test_double_array():
    rnd = random.Random(1)
    words = {}
    for i in range(3000):
        words[bytes(rnd.choice(b"abc\xff\x00\x80") for _ in range(rnd.randint(1, 7)))] = i
    base, check, value = double_array(words)
    for w, i in words.items():
        node = 0
        for b in w:
            child = base[node] + b
            assert check[child] == node
            node = child
        assert value[node] == i
    assert (value >= 0).sum() == len(words)


def test_digests_are_those_of_ids_and_texts(spark, monkeypatch):
    """Small blocks and a dictionary that is begun anew all the time change nothing."""
    import hashlib

    from depframe.llm import sentence_pieces
    from depframe.llm.queries import vocabulary

    texts = [None, "", " ", "x\nlists of y", "aé漢 \u2581 b  c", "one two three " * 50, "\x00\ufffd😀"]
    model = PieceModel.load(vocabulary("piece_bpe_32k.model"))

    def told(t):
        ids = model.encode(t).tolist()
        back = model.decode(ids)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        return len(ids), sum(i in model.byte_ids for i in ids), sha(" ".join(map(str, ids))), sha(back), back == (t or "")

    expected = [told(t) for t in texts]
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, n_ids string").repartition(3)
    got = {r["doc_id"]: tuple(r[c] for c in ("n_ids", "n_byte_ids", "ids_sha256", "decoded_sha256", "round_trip")) for r in digest_columns(df, model).collect()}
    assert [got[i] for i in range(len(texts))] == expected
    monkeypatch.setattr(sentence_pieces, "BLOCK_CHUNKS", 3)
    monkeypatch.setattr(sentence_pieces, "KNOWN_BYTES", 900)
    assert [model.digests(t) for t in texts] == expected == [told(t) for t in texts]
