from pyspark.sql import functions as F

from depframe.llm.queries import URL_RULES
from depframe.llm.url_filters import bloom_blocks, canonical_url, in_list, url_filter

URLS = [
    None, "", "no scheme", "http://", "https://A.Example.COM/en/71?x#y", "http://example.com/en/8", "http://sub.example.com/en/8", "http://notcom/en/1",
    "http://x.net/de/1", "http://example.net/de/8", "http://example.net/de/9", "http://a.org/es/", "http://a.org?q=/es/", "http://É.org/es/x", "ftp://a.org#/x://b",
    "http://bad.host/p/?utm_source=1&b=2&a=1#z", "http://bad.host:80/p?a=1&b=2", "http://bad.host/p?a=1",
]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = rest[:cut], rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in URL_RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return host, path, max(fits, key=lambda r: (len(r[1]), len(r[2])), default=None)


def test_rules_and_list(spark):
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(URLS + URLS)], "page_id long, url string, verdict string")
    listed = spark.createDataFrame([("bad.host/p?a=1&b=2",), (None,), ("bad.host/p?a=1&b=2",)], "canonical string")
    out = url_filter(pages, URL_RULES, listed).collect()
    assert len(out) == 2 * len(URLS)
    for r in out:
        host, path, rule = brute(r["url"])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule[1] + rule[2])
        if rule:
            assert r["verdict"] == rule[0]
        else:
            hit = r["url"] in ("http://bad.host/p/?utm_source=1&b=2&a=1#z", "http://bad.host:80/p?a=1&b=2")
            assert r["verdict"] == ("block" if hit else "allow")


def test_crowded_filter_stays_exact(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("k"))
    listed = keys.where("id % 3 = 0" if "id" in keys.columns else "cast(substr(k, 2) as int) % 3 = 0").withColumnRenamed("k", "canonical")
    for max_blocks in (1 << 16, 4):  # broadcast, and split by block
        out = in_list(keys, F.col("k"), listed, max_blocks=max_blocks)
        assert out.where("listed").count() == 1000
        assert out.where("listed and cast(substr(k, 2) as int) % 3 != 0").count() == 0
    assert bloom_blocks(listed, blocks=16).count() <= 16


def test_rows_without_a_key_are_dealt_out(spark):
    """In the split form too, and whatever types the caller's columns have: maps cannot be hashed."""
    rows = spark.range(2000).selectExpr("id", "if(id % 4 = 0, cast(id as string), null) k", "map('a', id) m", "struct(map(1, id) as x) s")
    listed = spark.createDataFrame([("8",), ("12",)], "canonical string")
    for columns in (["id", "k", "m", "s"], ["k", "m"]):
        for max_blocks in (1 << 16, 4):
            out = in_list(rows.select(*columns), F.col("k"), listed, max_blocks=max_blocks)
            assert out.columns == [*columns, "listed"] and out.count() == 2000
            assert sorted(r["k"] for r in out.where("listed").select("k").collect()) == ["12", "8"]


def test_clashing_columns_come_back_as_they_were(spark):
    names = ("listed", "block", "bits", "__key", "__k", "__row", "row", "canonical")
    df = spark.createDataFrame([(1, "http://bad.host/p", *range(len(names)))], "page_id long, url string, " + ", ".join(f"`{n}` int" for n in names))
    (r,) = url_filter(df, URL_RULES, spark.createDataFrame([("bad.host/p",)], "canonical string")).collect()
    assert r["verdict"] == "block" and [r[n] for n in names] == list(range(len(names)))


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filter(pages, URL_RULES, pages.select(canonical_url(F.col("url")).alias("canonical"))).count() == 0
