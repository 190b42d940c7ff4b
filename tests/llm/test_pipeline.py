import corpus_pipeline as cp

LONG = "this passage is shared by several documents and it is much longer than one hundred bytes so that it repeats as a whole "


def test_stages_take_effect(spark):
    words = lambda k, n=60: " ".join(f"{'abcdefgh'[(i * k) % 8]}{(i * i + k * 97) % 1009:x}ing" for i in range(n))
    near = words(3, 200)
    rows = [
        (1, words(1) + " " + LONG + words(2)), (2, words(4) + " " + LONG + words(5)), (3, near), (4, near.replace(near.split()[9], "changed", 1)), (5, near),
        (6, words(7) + " password = hunter2hunter2 " + words(8)), (7, "too short"), (8, None), (9, ("junk ### $$$ %%% " * 30)), (None, words(11)),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {}
    for name, stage in cp.STAGES:
        docs = cp.materialise(stage(spark, docs, ""), "test-" + name)
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
        if name != cp.STAGES[-1][0]:
            assert tuple(docs.columns) == cp.COLUMNS
    assert set(kept["quality_rules"]) == {1, 2, 3, 4, 5, 6, None}
    assert set(kept["jaccard_join"]) == {1, 2, 3, 6, None}
    cut = kept["suffix_dedup"]
    assert LONG in cut[1]["text"] and LONG not in cut[2]["text"] and words(5) in cut[2]["text"] and cut[2]["n_chars"] == len(cut[2]["text"])
    assert "hunter2" not in kept["secret_scan"][6]["text"] and "[SECRET]" in kept["secret_scan"][6]["text"]
    assert set(kept["packing"]) == {1, 2, 3, 6, None}


def test_empty_corpus(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0
