"""Secret scans: three base patterns, then a battery of randomness tests with false-discovery control.

Only DataFrame functions are used. Where a match lies follows from the lengths of the pieces between matches, so
one ``split`` and one ``regexp_extract_all`` give spans.

The battery looks at tokens of 20 characters and more, ended by an inner ``=`` (which is no more than padding at the end of
a token), infers an encoding from their alphabet, and tests the hypothesis that symbols are drawn uniformly: Pearson's chi-squared over the alphabet (with the
exact variance of its length), the number of runs above and below the alphabet's middle, and lag-one serial
correlation. The least of the three p-values, times three, is the token's. A token is structured text if the procedure of
Benjamini and Hochberg rejects it among the tokens of its length band, at ``RATE`` false rejections: short tokens, with
little power, are not judged by what long ones show. What stays is random enough to be a secret. The procedure needs only
counts of p-values per band and bin, a table of at most ``BANDS`` times ``BINS`` + 1 rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depframe.session import materialise

#: Fixed values. The base patterns.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # a run of under 16 has no later start that reaches 16
HEX = r"[0-9a-f]{32,}"  # likewise
KINDS = ("assign", "access", "hex", "random")
#: Tokens of the battery and the alphabets of encodings, the narrowest that fits first.
TOKEN = r"[A-Za-z0-9+/_-]{20,}(?:=++(?![A-Za-z0-9+/_-]))?"
ALPHABETS = [
    ("hex", "0123456789ABCDEF", r"^[0-9A-F]+$"),
    ("hex", "0123456789abcdef", r"^[0-9a-f]+$"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", r"^[A-Z2-7]+$"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz", r"^[0-9a-z]+$"),
    ("base62", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", r"^[A-Za-z0-9]+$"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", r"^[A-Za-z0-9+/]+$"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", r"^[A-Za-z0-9_-]+$"),
]
#: Least lengths of the bands.
BAND_FROM = (20, 32, 48, 96)
BANDS, BINS, RATE = len(BAND_FROM), 200, 0.05
MASK = "[SECRET]"


def _matches(t: Column, pattern: str, group: int | None = None, least: int = 0) -> Column:
    """Spans (s, e, v) of the leftmost non-overlapping matches in code points; v is the match. Only those with ``group`` of ``least`` characters count."""
    p = F.lit(pattern)
    found = F.regexp_extract_all(t, p, F.lit(0))
    value = F.regexp_extract_all(t, p, F.lit(group)) if group else found
    gaps = F.transform(F.split(t, pattern, -1), lambda g: F.length(g))
    rows = F.arrays_zip(gaps.alias("g"), found.alias("v"), value.alias("x"))
    span = "struct<s:int,e:int,v:string>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("out"))

    def step(acc: Column, r: Column) -> Column:
        s = acc["at"] + r["g"]
        e = s + F.coalesce(F.length(r["v"]), F.lit(0))
        new = F.array(F.struct(s.alias("s"), e.alias("e"), r["v"].alias("v")).cast(span))
        keep = r["v"].isNotNull() & (F.length(r["x"]) >= least)
        return F.struct(e.alias("at"), F.when(keep, F.concat(acc["out"], new)).otherwise(acc["out"]).alias("out"))

    return F.when(t.rlike(pattern), F.aggregate(rows, start, step)["out"]).otherwise(F.array().cast(f"array<{span}>"))


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal, by its logistic approximation (error under 2e-4)."""
    return 1 / (1 + F.exp(0.07056 * z * z * z + 1.5976 * z))


def _battery(token: Column) -> Column:
    """p-value of uniformity of a token; null where no encoding fits."""
    bare = F.regexp_replace(token, "=+$", "")
    p = F.lit(None).cast("double")
    for _, letters, pattern in reversed(ALPHABETS):
        p = F.when(bare.rlike(pattern), _uniformity(bare, letters)).otherwise(p)
    return p


def _uniformity(token: Column, letters: str) -> Column:
    k = len(letters)
    n = F.length(token).cast("double")
    values = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(F.lit(letters), c) - 1)
    # All of the tests need values several times: bound once as a lambda's argument.
    def tests(v: Column) -> Column:
        squares = F.aggregate(F.array(*(F.lit(i) for i in range(k))), F.lit(0.0), lambda a, i: a + F.pow(F.size(F.filter(v, lambda x: x == i)).cast("double"), 2.0))
        chi = k / n * squares - n
        p_chi = _upper_tail((chi - (k - 1)) / F.sqrt(2.0 * (k - 1) * (n - 1) / n))
        pairs = F.filter(F.zip_with(v, F.slice(v, 2, 1 << 30), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda x: x["b"].isNotNull())
        turns = F.size(F.filter(pairs, lambda x: (x["a"] >= k // 2) != (x["b"] >= k // 2))).cast("double")
        p_runs = 2 * _upper_tail(F.abs((turns - (n - 1) / 2) / F.sqrt((n - 1) / 4)))
        mid, var = (k - 1) / 2, (k * k - 1) / 12
        serial = F.aggregate(pairs, F.lit(0.0), lambda s, x: s + (x["a"] - mid) * (x["b"] - mid)) / var
        p_serial = 2 * _upper_tail(F.abs(serial / F.sqrt(n - 1)))
        return F.least(F.lit(1.0), 3 * F.least(p_chi, p_runs, p_serial))

    return F.transform(F.array(values), tests)[0]


def _band(length: Column) -> Column:
    band = F.lit(0)
    for i, low in enumerate(BAND_FROM[1:], 1):
        band = F.when(length >= low, i).otherwise(band)
    return band


def with_candidates(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``__base`` (spans of the base patterns) and ``__tokens`` (spans, p-value and band of the battery's)."""
    df = df.withColumn("__t", F.coalesce(F.col(text).cast("string"), F.lit("")))
    t = F.col("__t")
    df = df.withColumns({"__assign": _matches(t, ASSIGN, 2, 8), "__access": _matches(t, ACCESS), "__hex": _matches(t, HEX), "__long": _matches(t, TOKEN)})
    kind = lambda c, k: F.transform(F.col(c), lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))
    df = df.withColumn("__base", F.sort_array(F.concat(kind("__assign", 0), kind("__access", 1), kind("__hex", 2))))
    base = F.col("__base")
    clear = F.filter("__long", lambda x: ~F.exists(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    judged = F.transform(clear, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), _battery(x["v"]).alias("p"), _band(F.length(x["v"])).alias("band")))
    return df.withColumn("__tokens", F.filter(judged, lambda x: x["p"].isNotNull())).drop("__t", "__assign", "__access", "__hex", "__long")


def _bin(p: Column) -> Column:
    """Bins of p-values; bin b holds those up to (b + 1) / BINS * RATE, the last all above RATE."""
    return F.least(F.floor(p / RATE * BINS), F.lit(BINS)).cast("int")


def rejection_bins(scanned: DataFrame) -> dict[int, int]:
    """For each band the last bin that the step-up procedure rejects, -1 for none. At most BANDS numbers reach the driver."""
    tokens = scanned.select(F.explode("__tokens").alias("x")).select("x.band", _bin(F.col("x.p")).alias("bin"))
    counts = tokens.groupBy("band", "bin").count()
    run, whole = Window.partitionBy("band").orderBy("bin"), Window.partitionBy("band")
    counts = counts.withColumn("run", F.sum("count").over(run)).withColumn("all", F.sum("count").over(whole))
    passed = counts.where((F.col("bin") < BINS) & ((F.col("bin") + 1) / BINS * F.col("all") <= F.col("run")))
    return {r["band"]: r["last"] for r in passed.groupBy("band").agg(F.max("bin").alias("last")).collect()}


def secret_scan(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``secrets``: an array of (s, k, e) sorted by start, then kind; k indexes ``KINDS``, code points, end exclusive.

    The base patterns' spans are always there; the battery adds tokens that do not overlap them. Null and empty texts have none.
    Repeated rows get equal spans; an empty table gives an empty table. A column ``secrets`` is replaced.
    ``df`` is read once and its rows written down with their candidates, so give it only the columns to keep.
    """
    scanned = materialise(with_candidates(df.drop("secrets") if text != "secrets" else df, text), "secrets")
    return _decided(scanned).drop("__base", "__tokens")


def _decided(scanned: DataFrame) -> DataFrame:
    last = rejection_bins(scanned)
    table = F.array(*(F.lit(last.get(b, -1)) for b in range(BANDS)))
    random = F.filter("__tokens", lambda x: _bin(x["p"]) > F.get(table, x["band"]))
    added = F.transform(random, lambda x: F.struct(x["s"].alias("s"), F.lit(3).alias("k"), x["e"].alias("e")))
    return scanned.withColumn("secrets", F.sort_array(F.concat("__base", added)))


def span_report(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_assign, n_access, n_hex, base_sha256 and spans of every row of ``df``; the texts themselves are not written down."""
    scanned = with_candidates(df.select(F.col(key), F.col(text).alias("__text")), "__text").drop("__text")
    found = _decided(materialise(scanned, "secrets"))
    names = F.array(*(F.lit(k) for k in KINDS))
    told = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")
    count = lambda k: F.size(F.filter("__base", lambda x: x["k"] == k)).cast("long")
    return found.select(
        key, count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(told(F.col("__base")), 256).alias("base_sha256"), told(F.col("secrets")).alias("spans"),
    )


def masked(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by ``MASK``; spans that overlap are replaced as one."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        piece = F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit(MASK))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(x["s"] >= acc["at"], piece).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
