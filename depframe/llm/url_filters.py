"""URL filters: prefix rules, then a blocked Bloom filter in front of an exact hash join.

Only DataFrame functions are used. The Bloom filter is a table of 64-bit blocks: a key picks one
block and sets ``BITS`` bits in it, so a probe is one equi-join on the block number. There is a block for every
``KEYS_PER_BLOCK`` listed URLs, so a filter lets few others through whatever the list's length. Up to ``MAX_BLOCKS`` blocks (16 bytes each) it is
broadcast; a longer filter is split by block number, and only keys and bits meet there, not whole rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depframe.session import materialise

MAX_BLOCKS = 1 << 16
KEYS_PER_BLOCK = 6
BITS = 5
SCHEMES = {"http": "80", "https": "443"}


def url_host(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical_url(url: Column) -> Column:
    """Host without default port, path without its last ``/``, query without tracking parameters; no scheme or fragment.

    Null or a text without ``://`` gives null: such a row can be on no list.
    """
    host = F.regexp_replace(url_host(url), r":(80|443)$", "")
    path = F.regexp_replace(url_path(url), r"/+$", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&", -1), lambda p: (p != "") & ~p.rlike(r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"))
    query = F.array_join(F.sort_array(kept), "&")
    whole = F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(F.contains(url, F.lit("://")), whole)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest fitting rule of ``rules`` = (verdict, host, path); null where none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1]), len(r[2]))):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text = F.when(fits, F.lit(rule_host + rule_path)).otherwise(text)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("block")), F.lit(blocks))


def _mask(key: Column) -> Column:
    h = F.xxhash64(key, F.lit("bits"))
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(BITS)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def bloom_blocks(listed: DataFrame, key: str = "canonical", blocks: int = MAX_BLOCKS) -> DataFrame:
    """Blocked Bloom filter of ``listed[key]`` as (block, bits), ``blocks`` rows at most. Nulls are left out."""
    rows = listed.where(F.col(key).isNotNull()).select(_block(F.col(key), blocks).alias("block"), _mask(F.col(key)).alias("m"))
    return rows.groupBy("block").agg(F.bit_or("m").alias("bits"))


def in_list(df: DataFrame, key: Column, listed: DataFrame, listed_key: str = "canonical", max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """``df`` with a boolean column ``listed``: whether ``key`` is one of ``listed[listed_key]``, exactly.

    Rows that the Bloom filter rules out never take part in the exact join, so nothing of them is shuffled for it.
    A null key is not listed. Repeated rows stay repeated. An empty list gives false everywhere.
    Columns of ``df`` keep their names, whatever they are; a column ``listed`` is replaced.
    """
    keys = materialise(listed.select(F.col(listed_key).alias("__key")).where("__key is not null").distinct(), "listed")
    blocks = 1 << max(4, math.ceil(math.log2(max(1, keys.count()) / KEYS_PER_BLOCK)))
    bloom = bloom_blocks(keys, "__key", blocks)
    bloom = F.broadcast(bloom) if blocks <= max_blocks else bloom.hint("merge")
    # The caller's columns travel as one struct, so none of them can clash with those worked on here.
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns if c != "listed")).alias("__row"), key.alias("__k"))
    # Rows without a key are in no block; numbers of their own deal them out where the filter is split.
    hashed = [F.col(f"__row.`{c}`") for c, kind in df.dtypes if c != "listed" and "map<" not in kind and "variant" not in kind]
    own = -1 - F.pmod(F.xxhash64(*hashed), F.lit(1 << 20)) if hashed else F.lit(-1)
    probed = rows.withColumn("block", F.when(F.col("__k").isNull(), own).otherwise(_block(F.col("__k"), blocks))).join(bloom, "block", "left")
    maybe = F.coalesce(F.col("__k").isNotNull() & (F.col("bits").bitwiseAND(_mask(F.col("__k"))) == _mask(F.col("__k"))), F.lit(False))
    probed = probed.select("__row", "__k", maybe.alias("__maybe"))
    passed = probed.where("__maybe").join(keys.withColumn("listed", F.lit(True)), F.col("__k") == F.col("__key"), "left")
    passed = passed.select("__row.*", F.coalesce("listed", F.lit(False)).alias("listed"))
    return probed.where("not __maybe").select("__row.*", F.lit(False).alias("listed")).unionByName(passed)


def url_filter(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame, url: str = "url", max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    The longest fitting rule decides; else a page whose canonical URL is among ``listed`` (column canonical)
    is blocked and any other allowed. Columns of these names in ``pages`` are replaced, others come back whatever their names. Null and malformed
    URLs have empty host and path, fit no rule and are allowed. An empty table gives an empty table.
    """
    new = ("host", "path", "rule", "verdict")
    row = F.struct(*(F.col(f"`{c}`") for c in pages.columns if c not in new))
    df = pages.select(row.alias("row"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"), F.col(url).alias("url"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    df = df.withColumns({"rule": rule, "verdict": verdict})
    judged = in_list(df, F.when(F.col("rule").isNull(), canonical_url(F.col("url"))), listed, max_blocks=max_blocks)
    by_list = F.when(F.col("listed"), "block").otherwise("allow")
    return judged.select("row.*", "host", "path", "rule", F.coalesce("verdict", by_list).alias("verdict"))
