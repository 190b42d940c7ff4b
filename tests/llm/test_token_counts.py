import public_tokenizers
from tokenizers import Tokenizer

from depframe.llm.chunked_encoding import ChunkEncoder, WordEncoder, drops_space_and_case
from depframe.llm.token_counts import stored_counts, token_counts, tokenizer_digest
from depframe.session import scratch_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "\n", "a", "  lead", "trail  \n", "two  blanks\n\nlines\n x", "tab\t mix    of spaces", "don't we'll I'm 'S", "x\n\n\n  y",
    "a <|endoftext|> b<|endoftext|>", "été 漢字 \U0001f600 123 4.5 !!??", "é ́x", "Σας ΣΑΣ İI", "word " * 3000, "x" * 5000, "\x1c a \x85b", "a \n b \n\n c",
]


def test_chunks_give_the_ids_of_whole_texts():
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        whole = Tokenizer.from_file(path)
        got = ChunkEncoder(path, list).encode(TEXTS)
        for text, chunks in zip(TEXTS, got, strict=True):
            assert [i for c in chunks for i in c] == whole.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_words_give_the_ids_of_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    assert drops_space_and_case(path) and not drops_space_and_case(PATH)
    whole, encoder = Tokenizer.from_file(path), WordEncoder(path)
    more = ["Word, word. WORD! (x), it's, ΣΑΣ, Ünïté; İstanbul. e\u0301t\u00e9 a\0b \0 \0, x<|endoftext|>, <|EndOfText|>. 12, ..., !? a.b.c.", "\u1e9e ŉ ǅ, ﬁn."]
    for _ in range(2):
        for text, packed in zip(TEXTS + more, encoder.encode(TEXTS + more), strict=True):
            assert b"".join(packed) == b"".join(i.to_bytes(4, "little") for i in whole.encode(text or "", add_special_tokens=False).ids), repr(text)


def test_counts_and_cache(spark):
    whole = Tokenizer.from_file(PATH)
    cache = scratch_path(spark, "cache")
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS + TEXTS[:7])], "doc_id long, text string, n_tokens int")
    out = token_counts(df, PATH, cache).collect()
    assert len(out) == len(TEXTS) + 7
    for r in out:
        t = (TEXTS + TEXTS)[r["doc_id"]] or ""
        n = len(whole.encode(t, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 512), repr(t)
    key = tokenizer_digest(PATH)
    before = stored_counts(spark, key, cache).count()
    assert before == len({t or "" for t in TEXTS})
    # A stored count is used, not made again.
    forged = df.where("doc_id = 4").selectExpr("unhex(sha2('brand new', 256)) digest", "77L n_tokens", f"'{key}' tokenizer")
    forged.write.mode("append").partitionBy("tokenizer").parquet(cache)
    again = token_counts(spark.createDataFrame([(1, "brand new"), (2, "a")], "doc_id long, text string"), PATH, cache)
    assert {r["doc_id"]: r["n_tokens"] for r in again.collect()} == {1: 77, 2: 1}
    assert stored_counts(spark, key, cache).count() == before + 1
    assert token_counts(df.limit(0), PATH, cache).count() == 0


def test_clashing_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, "one two", b"own", 5, 6)], "doc_id long, text string, digest binary, tokenizer int, n_tokens int")
    (r,) = token_counts(df, public_tokenizers.path("byte_bpe_50k.json"), f"file://{tmp_path}/cache").collect()
    assert bytes(r["digest"]) == b"own" and r["tokenizer"] == 5 and r["n_tokens"] > 0 and r["n_bytes"] == 7
