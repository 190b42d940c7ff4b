"""N-gram Jaccard join by PartEnum signatures.

A document's set holds the hashes of its distinct word shingles. Two sets that reach the threshold differ in at most k
elements, where k follows from their sizes. Sizes fall into bands; for every band (and the one below, where partners may lie)
the domain of shingles is dealt to n1 groups of n2 partitions, and a signature is the content of a subset of n2 - k2
partitions of a group. With k differing elements some group has at most k2 of them, so some subset of it agrees.
Small sets enumerate subsets of two of three partitions, large ones take single partitions.

Empty subsets agree for free and would put all small sets into one bucket, so they make no signature. That loses
nothing as there are ``spare`` groups beyond what the argument needs: a pair is only at risk if both sets have more than
``spare`` groups with an empty subset, and such sets sign again under another dealing; in the last dealing empty subsets count.

Signatures cross the network once; only those of buckets with two documents are written. A set that shares fewer of them with all others than it must share
with any partner is left out. Copies: sets equal within a task sign
once, and those equal across tasks are linked by their digest.

Buckets: pairs of a bucket are never formed. The centre of a bucket is its most popular set (whose buckets hold most
rows); the original of a group of near copies is the centre of all its buckets. Each set is first compared with the centre it meets
most often, and what this links is one component. In buckets that still hold several components every set is compared with the bucket's own centre
c, which gives its difference A from c, the elements that only one of the two has. Two sets differ from each other in |A| + |B| - 2 |A and B| elements. So a
pair that reaches the threshold, at least one of which is not linked with c, must share a large part of A and B: sets
unrelated but for c, as independent edits of one text are, share next to none. The sets of one centre are joined on their
elements of A by a prefix filter, elements that c lacks first, and what they share of those bounds the rest; only pairs that may still reach the
threshold are held against each other in full. This is
exact and without any cap, and its cost follows the number of sets, not the square of a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depframe.llm.byte_hashing import PrefixHash, mix, slices, text_bytes
from depframe.operators.components import connected_components
from depframe.session import discard, materialise

GROWTH = 1.5
DEALINGS = 4
#: Bands whose sets may differ in up to this many elements enumerate subsets.
ENUMERATED = 10
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Band(NamedTuple):
    low: int
    high: int
    differ: int
    n1: int
    n2: int
    k2: int
    spare: int


@cache
def bands(num: int, den: int, largest: int) -> tuple[Band, ...]:
    """The bands of sizes up to ``largest`` and their schemes for the threshold num / den."""
    out, low = [], 1
    while low <= largest:
        high = max(low + 1, math.ceil(low * GROWTH))
        while _differ(high, num, den) == 0:
            high += 1
        k = _differ(high - 1, num, den)
        if k == 0:
            out.append(Band(low, high, 0, 1, 1, 0, 0))
        else:
            n2, k2 = (3, 1) if k <= ENUMERATED else (1, 0)
            groups = k // (k2 + 1) + 1
            spare = _spare(groups, n2, low)
            out.append(Band(low, high, k, groups + spare, n2, k2, spare))
        low = high
    return tuple(out)


def _spare(groups: int, n2: int, size: int) -> int:
    """Groups to add so that few sets of ``size`` have more groups with an empty subset than that; small bands leave more to further dealings."""
    if n2 > 1:
        return 1 + groups // 12
    spare = 1
    for _ in range(12):
        hole = math.exp(-size / (groups + spare))
        spare = min(2 + groups // 5, 1 + math.ceil(1.2 * (groups + spare) * hole + (groups * hole) ** 0.5))
    return spare


def _differ(size: int, num: int, den: int) -> int:
    """Most elements in which a set of ``size`` and a partner of that size or more can differ."""
    return (size + den * size // num) * (den - num) // (den + num)


def shingle_hashes(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text: its words in lower case (A-Z), or all of them as one where there are fewer."""
    data, offsets = text_bytes(column)
    for first, last in slices(offsets):
        part, at = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        word = ~_SPACE[part]
        edge = np.zeros(len(part) + 1, bool)
        edge[at] = True
        starts = np.flatnonzero(word & (edge[:-1] | ~np.r_[False, word[:-1]]))
        ends = np.flatnonzero(word & (edge[1:] | ~np.r_[word[1:], False])) + 1
        hashes = PrefixHash(_LOWER[part])(starts, ends)
        bounds = np.searchsorted(starts, at)
        with np.errstate(over="ignore"):
            joined = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
            for k in range(words):
                joined += mix(hashes[k : k + len(joined)] + np.uint64(k)) * np.uint64(2 * k + 3)
            joined = mix(joined)
            for i in range(last - first):
                a, b = bounds[i], bounds[i + 1]
                if b - a >= words:
                    yield np.unique(joined[a : b - words + 1])
                elif b > a:
                    few = sum((mix(hashes[a + k : a + k + 1] + np.uint64(k)) * np.uint64(2 * k + 5) for k in range(b - a)), np.zeros(1, np.uint64))
                    yield mix(few + np.uint64(b - a))
                else:
                    yield np.zeros(0, np.uint64)


def _sums(parts: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """64-bit sums of ``values`` by part."""
    low = np.bincount(parts, (values & np.uint64(0xFFFFFFFF)).astype(np.float64), n).astype(np.uint64)
    high = np.bincount(parts, (values >> np.uint64(32)).astype(np.float64), n).astype(np.uint64)
    return low + (high << np.uint64(32))


@cache
def _subsets(n2: int, k2: int) -> np.ndarray:
    return np.array(list(combinations(range(n2), n2 - k2)))


def own_band(size: int, num: int, den: int) -> tuple[int, tuple[Band, ...]]:
    """Number of the band of ``size``, and all bands."""
    family = bands(num, den, 1 << max(8, int(size).bit_length() + 1))
    return next(i for i, b in enumerate(family) if b.low <= size < b.high), family


class Signed(NamedTuple):
    """The signatures of a set, the last byte of each its band and dealing; its band; the least number of signatures that it shares with
    a partner, in its own band and in the one below."""

    signatures: np.ndarray
    band: int
    least: int
    below: int


def signatures(hashes: np.ndarray, num: int, den: int) -> Signed:
    """All signatures of a set: of its band and, where a partner may be smaller than the band, of the one below.

    All but differ / (k2 + 1) groups of the first dealing agree with a partner, and those without an empty subset share a signature each. Where a set
    signs again because too many subsets are empty, the least number is 1.
    """
    size = len(hashes)
    own, family = own_band(size, num, den)
    tags = [own] + [own - 1] * (own > 0 and num * size <= den * (family[own].low - 1))
    content, out, least = mix(hashes + np.uint64(11)), [], {}
    for tag in tags:
        b = family[tag]
        differ = _differ(size, num, den) if tag == own else (size + b.high - 1) * (den - num) // (den + num)
        for dealing in range(DEALINGS):
            n = b.n1 * b.n2
            parts = (mix(hashes ^ np.uint64((tag << 8) + dealing + 1)) % np.uint64(n)).astype(np.int64)
            sums = _sums(parts, content, n).reshape(b.n1, b.n2)
            counts = np.bincount(parts, minlength=n).reshape(b.n1, b.n2)
            chosen = _subsets(b.n2, b.k2)
            filled = counts[:, chosen].sum(2) > 0
            total = np.zeros((b.n1, len(chosen)), np.uint64)
            for j in range(chosen.shape[1]):
                total += mix(sums[:, chosen[:, j]] + np.uint64(j + 1)) * (counts[:, chosen[:, j]] > 0)
            name = np.arange(b.n1 * len(chosen), dtype=np.uint64).reshape(total.shape) + np.uint64((tag << 40) + (dealing << 32))
            total = (mix(total ^ mix(name)) & ~np.uint64(255)) | np.uint64(tag * DEALINGS + dealing)
            holes = int((~filled.all(1)).sum())
            sure = holes <= b.spare
            if not dealing:
                least[tag] = max(1, b.n1 - differ // (b.k2 + 1) - holes) if sure else 1
            out.append(total[filled] if sure or dealing < DEALINGS - 1 else total.ravel())
            if sure:
                break
    return Signed(np.concatenate(out), own, least[own], least.get(own - 1, 1))


#: Rows of a signature (s, id) and of a document (s is arbitrary; id, n, digest, and, where this row has signatures, their band, least and below).
SIGNED = "s long, id long, n long, digest binary, band int, least int, below int"
_SIGNED = pa.schema([("s", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), *((c, pa.int32()) for c in ("band", "least", "below"))])
BATCH_ROWS = 100_000


def _sign(words: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        row = 0
        for batch in batches:
            ids, told, signs, owners, rows = batch.column("id"), [], [], [], 0
            for h, key in zip(shingle_hashes(batch.column("text"), words), ids.to_pylist(), strict=True):
                digest, about = None, (None, None, None)
                if len(h):
                    with np.errstate(over="ignore"):
                        digest = np.array([mix(h).sum(dtype=np.uint64), mix(h + np.uint64(99)).sum(dtype=np.uint64), len(h)], np.uint64).tobytes()
                        if key is not None and digest not in seen:
                            seen.add(digest)
                            found = signatures(h, num, den)
                            about = found[1:]
                            signs.append(found.signatures.view(np.int64))
                            owners.append(np.full(len(signs[-1]), key, np.int64))
                            rows += len(signs[-1])
                told.append((len(h), digest, *about))
                if rows >= BATCH_ROWS:
                    yield _signature_rows(signs, owners)
                    signs, owners, rows = [], [], 0
            if rows:
                yield _signature_rows(signs, owners)
            # Documents are dealt out anywhere: by a number of their own.
            with np.errstate(over="ignore"):
                spread = mix(np.arange(row, row + len(told), dtype=np.uint64)).view(np.int64)
            row += len(told)
            made = [pa.array([t[i] for t in told], kind) for i, kind in enumerate(_SIGNED.types[2:])]
            yield pa.RecordBatch.from_arrays([pa.array(spread), ids, *made], schema=_SIGNED)

    return run


def _signature_rows(signs: list[np.ndarray], owners: list[np.ndarray]) -> pa.RecordBatch:
    s = pa.array(np.concatenate(signs))
    return pa.RecordBatch.from_arrays([s, pa.array(np.concatenate(owners)), *(pa.nulls(len(s), k) for k in _SIGNED.types[2:])], schema=_SIGNED)


def _sets(words: int, others: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, lo, size = [], 0, 0
            for i, h in enumerate(shingle_hashes(batch.column("text"), words)):
                hashes.append(h.view(np.int64))
                size += len(h)
                if size >= BATCH_ROWS or i + 1 == batch.num_rows:
                    rows = batch.slice(lo, len(hashes))
                    yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in others), pa.array(hashes, pa.list_(pa.int64()))], [*others, "hashes"])
                    hashes, lo, size = [], i + 1, 0

    return run


def with_differences(pairs: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """The distinct ``pairs`` (id, c, and columns that hang on id) with n and nc, the sizes of their sets, away, in how many elements they
    differ, and lacking and extra, the elements only c or only id has.

    The sets of the c are few and travel once; those of the id go to their c.
    """
    more = [c for c in pairs.columns if c not in ("id", "c")]
    kinds = "".join(f", `{n}` {t}" for n, t in pairs.select(*more).dtypes)
    many = pairs.groupBy("id", *more).agg(F.collect_set("c").alias("cs"))
    left = docs.join(many, "id").mapInArrow(_sets(words, ("id", "cs", *more)), f"id long, cs array<long>{kinds}, hashes array<long>")
    left = left.select("id", *more, F.explode("cs").alias("c"), F.col("hashes").alias("x"))
    wanted = pairs.select(F.col("c").alias("id")).distinct()
    right = docs.join(wanted, "id", "left_semi").mapInArrow(_sets(words, ("id",)), "id long, hashes array<long>")
    both = left.join(right.select(F.col("id").alias("c"), F.col("hashes").alias("y")), "c")
    both = both.select("id", *more, "c", F.size("x").alias("n"), F.size("y").alias("nc"), F.array_except("y", "x").alias("lacking"), F.array_except("x", "y").alias("extra"))
    return both.withColumn("away", F.size("lacking") + F.size("extra"))


def _allowed(sizes: Column, num: int, den: int) -> Column:
    """Most elements in which two linked sets of that many elements together differ."""
    return F.floor(sizes * (den - num) / (den + num))


def _linked(num: int, den: int) -> Column:
    return (den + num) * F.col("away") <= (den - num) * (F.col("n") + F.col("nc"))


def _with_prefix(away: DataFrame, num: int, den: int) -> DataFrame:
    """``away`` with prefix, the first elements of A, of which a partner must share one, in place of lacking and extra.

    Of the prefix, the first ``loose`` are what a partner of any kind needs of a set not linked with c (0 for others), the first ``right`` what an
    unlinked partner needs. With a = |A| and k(x, y) allowed: |A and B| >= (a + b - k(x, y)) / 2, and a > k(x, c) if x is not linked.
    ``lack`` and ``more`` are the sizes of lacking and extra; extra elements come first.
    """
    p, q, a = den - num, den + num, F.col("away")
    gap = F.floor((F.col("nc") - F.col("n")) * p / q)
    farthest = F.floor((F.col("n") + F.floor(den * F.col("n") / num)) * p / q)
    share = lambda least: F.greatest(F.lit(1), F.ceil(least / 2), a - farthest)
    right = a - share(a + 1 + gap) + 1
    loose = F.when(_linked(num, den), 0).otherwise(a - share(a + 1 - F.floor((F.col("n") + F.col("nc") + 1) * p / q)) + 1)
    rows = away.withColumns({"right": right.cast("int"), "loose": loose.cast("int")})
    first = F.slice(F.concat(F.array_sort("extra"), F.array_sort("lacking")), F.lit(1), F.greatest("right", "loose", F.lit(0)))
    return rows.withColumns({"prefix": first, "lack": F.size("lacking"), "more": F.size("extra")}).drop("lacking", "extra")


def _candidates(away: DataFrame, num: int, den: int) -> DataFrame:
    """(id, c, pivot): pairs of different components that share an element of their prefixes and whose sizes and distances fit.

    What stands before the first shared element of A and B is not shared, so it is no more than the two may differ in.
    """
    rows = away.where("away > 0").select("c", "id", "n", "away", "component", "right", "loose", F.posexplode("prefix").alias("at", "e"))
    kept = Window.partitionBy("c", "e")
    shared = rows.withColumn("lo", F.min("component").over(kept)).withColumn("hi", F.max("component").over(kept)).where("lo != hi").drop("lo", "hi")
    names = ("id", "n", "away", "component", "at")
    x = shared.where("at < loose").select("c", "e", *(F.col(c).alias(f"{c}_x") for c in names))
    y = shared.where("at < right").select("c", "e", *(F.col(c).alias(f"{c}_y") for c in names))
    allowed = _allowed(F.col("n_x") + F.col("n_y"), num, den)
    most = F.least(F.col("away_x") - F.col("at_x"), F.col("away_y") - F.col("at_y"))  # elements that can be shared
    near = (F.col("at_x") + F.col("at_y") <= allowed) & (F.col("away_x") + F.col("away_y") - 2 * most <= allowed)
    close = den * F.least("n_x", "n_y") >= num * F.greatest("n_x", "n_y")
    met = x.join(y, ["c", "e"]).where((F.col("component_x") != F.col("component_y")) & near & close)
    return met.groupBy(F.greatest("id_x", "id_y").alias("id"), F.least("id_x", "id_y").alias("partner")).agg(F.min("c").alias("pivot")).withColumnRenamed("partner", "c")


def _possible(pairs: DataFrame, away: DataFrame, num: int, den: int) -> DataFrame:
    """The ``pairs`` (id, c, pivot) that may reach the threshold by the elements that their prefixes share.

    Shared elements are lacking ones, no more than the fewer of the two, extra ones in both prefixes, and extra ones beyond a prefix.
    """
    for end, side in (("id", "x"), ("c", "y")):
        extra = F.slice("prefix", F.lit(1), F.least(F.size("prefix"), F.col("more")))
        own = away.select(F.col("id").alias(end), F.col("c").alias("pivot"), *(F.col(c).alias(f"{c}_{side}") for c in ("n", "away", "lack", "more")), extra.alias(f"extra_{side}"))
        pairs = pairs.join(own, [end, "pivot"])
    beyond = F.greatest(F.col("more_x") - F.size("extra_x"), F.col("more_y") - F.size("extra_y"))
    most = F.size(F.array_intersect("extra_x", "extra_y")) + F.least("lack_x", "lack_y") + beyond
    return pairs.where(F.col("away_x") + F.col("away_y") - 2 * most <= _allowed(F.col("n_x") + F.col("n_y"), num, den)).select("id", "c").distinct()


def _edges(rows: DataFrame, num: int, den: int) -> DataFrame:
    return rows.where(_linked(num, den)).select(F.col("id").alias("a"), F.col("c").alias("b"))


def _shared_enough(members: DataFrame) -> DataFrame:
    """The rows of each set and band of which there are as many as a partner must share."""
    own = Window.partitionBy("id", F.col("s").bitwiseAND(255))
    return members.withColumn("there", F.count("*").over(own)).where("there >= least").drop("there")


def _mixed(members: DataFrame, edges: DataFrame) -> DataFrame:
    """``members`` of the buckets that hold several components, with the component that the links so far give."""
    classes = connected_components(edges).withColumnRenamed("node", "id")
    named = members.join(classes, "id", "left").withColumn("component", F.coalesce("component", "id"))
    bucket = Window.partitionBy("s")
    named = named.withColumn("lo", F.min("component").over(bucket)).withColumn("hi", F.max("component").over(bucket))
    mixed = materialise(_shared_enough(named.where("lo != hi").drop("lo", "hi")), "mixed")
    discard(classes)
    return mixed


def jaccard_classes(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(id, n, component) for every row: size of its shingle set and the least key that links reach, itself included.

    Two documents link when den * |intersection| >= num * |union|. A null or empty text, or one of white space, has an empty set and
    links with nothing, its component is its own key. Rows of one key are one document's; a null key has a null component and no
    links. Repeated rows stay repeated; an empty table gives an empty table. Other columns of ``df`` play no part, whatever their names.
    """
    docs = df.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    signed = docs.mapInArrow(_sign(words, num, den), SIGNED)
    bucket = Window.partitionBy("s")
    met = signed.withColumn("lo", F.min("id").over(bucket)).withColumn("hi", F.max("id").over(bucket))
    signed = materialise(met.where("n is not null or lo != hi").drop("lo", "hi"), "signatures")
    rows = signed.where("n is not null").select("id", "n", "digest", "band", "least", "below")
    usable = rows.where("id is not null and digest is not null")
    first = F.min(F.when(F.col("band").isNotNull(), F.struct("id", "band", "least", "below")))
    heads = materialise(usable.groupBy("digest").agg(first.alias("head")).select("digest", "head.*"), "heads")
    copies = usable.select("digest", F.col("id").alias("a")).join(heads.select("digest", F.col("id").alias("b")), "digest").where("a != b")
    edges = materialise(copies.select("a", "b").distinct(), "copies")

    # Sets that share fewer signatures with all others than a partner must share have none. Rows of one key may hold several sets.
    told = heads.groupBy("id").agg(F.count("*").alias("k"), *(F.min(c).alias(c) for c in ("band", "least", "below")))
    least = F.when((F.col("k") == 1) & (F.col("s").bitwiseAND(255) >= DEALINGS * F.col("band")), F.col("least")).when(F.col("k") == 1, F.col("below")).otherwise(1)
    members = signed.where("n is null").select("s", "id").join(told, "id").withColumn("least", least).select("s", "id", "least")
    members = _shared_enough(members)
    crowd = members.withColumn("k", F.count("*").over(bucket)).withColumn("popular", F.sum("k").over(Window.partitionBy("id")))
    centre = crowd.withColumns({"c": F.first("id").over(bucket.orderBy(F.desc("popular"), "id")), "lo": F.min("id").over(bucket), "hi": F.max("id").over(bucket)})
    members = materialise(centre.where("lo != hi").select("s", "id", "least", "c"), "buckets")
    discard(heads)
    known = materialise(docs.join(members.select("id").distinct(), "id", "left_semi"), "texts")
    meets = members.where("id != c").repartition("id").groupBy("id", "c").agg(F.count("*").alias("k"))
    first = materialise(meets.groupBy("id").agg(F.max_by("c", F.struct("k", -F.col("c"))).alias("c")), "first")
    star = materialise(with_differences(first, known, words).select("id", "c", "n", "nc", "away"), "star")
    edges = materialise(edges.union(_edges(star, num, den)).distinct(), "links")

    mixed = _mixed(members, edges)
    discard(members, first, star)
    pairs = mixed.where("id != c").select("id", "c", "component").distinct()
    away = materialise(_with_prefix(with_differences(pairs, known, words), num, den), "differences")
    edges = materialise(edges.union(_edges(away, num, den)).distinct(), "links")
    discard(mixed)
    near = materialise(_candidates(away, num, den), "candidates")
    found = materialise(_possible(near, away, num, den), "possible")
    discard(away, near)
    compared = materialise(with_differences(found, known, words).select("id", "c", "n", "nc", "away"), "compared")
    classes = connected_components(edges.union(_edges(compared, num, den)))
    discard(known, found, compared, edges)
    return rows.select("id", "n").join(classes.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
