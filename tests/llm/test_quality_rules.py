import re
from collections import Counter

import numpy as np

from depframe.llm.quality_rules import CONSISTENCY, GRID, mcd_estimates, quality_rules

SCHEMA = "doc_id long, text string, lang string, source string, quality string"


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = Counter(windows)
    covered = {j for i, w in enumerate(windows) if many[w] > 1 for j in range(i, i + 5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed)


def test_statistics_match_brute_force(spark):
    texts = [
        None, "", " \n\t ", "one", "a b c d e", "a b c d e f a b c d e", "x " * 40, "line one\nline one\n\n \nline two\nline one",
        "é ü ß 漢字 #*$%&|<>", "a\x0bb\x0cc\rd\x85e\u00a0f", "p q r s t u v w p q r s t u v w z " + " ".join(f"w{i}" for i in range(90)),
        "word " * 5 + " ".join(f"k{i}" for i in range(50)), " ".join(f"v{i % 997}" for i in range(5000)),
    ]
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 3 == 0 else "s", "clash") for i, t in enumerate(texts + texts[:4])]
    got = {}
    out = quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    for r in out:
        q = r["quality"]
        got[r["doc_id"]] = (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"], q["base_failed"])
        assert not (q["kept"] and q["base_failed"])
    for i, t, *_ in rows:
        assert got[i] == base(t), t


def test_outliers_go_and_usual_texts_stay(spark):
    usual = [(i, " ".join(f"wo{(i * 7 + j * j) % 9973:04d}" for j in range(60 + i % 50)), "en", f"s{i % 2}", "") for i in range(400)]
    odd = [(1000 + i, " ".join(f"w{(i * 5 + j * j) % 997}###" for j in range(60)), "en", "s0", "") for i in range(30)]
    kept = {r["doc_id"]: r["quality"]["kept"] for r in quality_rules(spark.createDataFrame(usual + odd, SCHEMA)).collect()}
    assert all(kept[r[0]] for r in usual)
    assert not any(kept[r[0]] for r in odd)


def test_empty_table(spark):
    assert quality_rules(spark.createDataFrame([], SCHEMA)).count() == 0


def test_clashing_columns_come_back_as_they_were(spark):
    names = ("x_length", "m_x_length", "__g", "__d2", "n_words", "quality", "kept", "c_x_length_x_length")
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(20 + i)), "en", "s", *range(len(names))) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` int" for n in names))
    for r in quality_rules(df).collect():
        assert [r[n] for n in names if n != "quality"] == [i for i, n in enumerate(names) if n != "quality"] and r["quality"]["n_words"] == 20 + r["doc_id"]


def test_a_group_of_one_row_is_judged_with_the_whole(spark):
    usual = [(i, " ".join(f"wo{(i * 7 + j * j) % 9973:04d}" for j in range(60 + i % 50)), "en", f"s{i}", "") for i in range(120)]
    odd = [(1000, " ".join(f"w{j}###" for j in range(60)), "fr", "own", "")]
    kept = {r["doc_id"]: r["quality"]["kept"] for r in quality_rules(spark.createDataFrame(usual, SCHEMA)).collect()}
    assert all(kept.values())
    assert quality_rules(spark.createDataFrame(usual + odd, SCHEMA)).where("not quality.kept").count() <= 1


def test_the_determinant_is_about_the_least(spark):
    """Against exact concentration steps from many random starts."""
    rnd = np.random.default_rng(3)
    clean = rnd.multivariate_normal([0, 50, 10, 5], [[900, 300, 0, 0], [300, 400, 0, 50], [0, 0, 500, 0], [0, 50, 0, 300]], 240)
    x = np.rint(np.r_[clean, rnd.normal([400, -200, 300, 200], 20, (60, 4))]).astype(int)
    floors = dict.fromkeys(("x_length", "x_symbols", "x_lines", "x_repeats"), 1 / GRID)

    def spread(some):
        return CONSISTENCY * np.cov(some.T, bias=True) + np.eye(4)

    best = np.inf
    for _ in range(40):
        some = x[rnd.choice(len(x), 30, replace=False)]
        for _ in range(30):
            d = some.mean(0) - x
            some = x[np.argsort(np.einsum("ij,jk,ik->i", d, np.linalg.inv(spread(some)), d))[: int(0.75 * len(x))]]
        best = min(best, np.linalg.slogdet(spread(some))[1])
    rows = [("g", *map(int, r)) for r in x] + [("h", 1, 2, 3, 4)]
    got = {r["__g"]: r for r in mcd_estimates(spark.createDataFrame(rows, "__g string, " + ", ".join(f"{n} long" for n in floors)), floors).collect()}
    assert got["g"]["__ld"] < best + 0.25 and abs(got["g"]["m_x_length"]) < 12
    assert [got["h"][f"m_{n}"] for n in floors] == [1, 2, 3, 4]
