"""Best-fit packing of token pieces into sequences by exact-complement hashing.

Documents become pieces of at most ``CAPACITY`` tokens in one pass, written down with each piece's number among those
of its length in its task. All that packing needs to know is how many pieces each length has: at most
``CAPACITY`` counts. From them ``plan`` makes patterns (lengths that fill one sequence) with the number of times each is used:
for every length from the longest, the hashed sums of single, pair and triple lengths give the combinations that fill its
gap exactly, used as often as the counts allow; what is left is packed best-fit, longest first. Every pattern
uses up a length or closes a kind of gap, so the plan is as small as the counts are, whatever the number of documents.
Pieces then take the places of their length in order. A piece's rank is its number in its task plus the pieces of that length in tasks before,
so no task ever holds all pieces of one length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depframe.llm.chunked_encoding import encoder
from depframe.llm.columns import carried, fields, inner
from depframe.session import materialise

CAPACITY = 2048
PIECES = "piece int, start long, length long, ids_crc32 long, __part int, __nth long"


def _pieces(path: str, capacity: int, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            row, out = [], {k: [] for k in ("piece", "start", "length", "ids_crc32", "nth")}
            for i, chunks in enumerate(encoder(path, "bytes").encode(batch.column(len(columns)).to_pylist())):
                chunks.append(b"\0\0\0\0")
                ids = b"".join(chunks)
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    body = ids[at : at + 4 * capacity]
                    n = len(body) // 4
                    row.append(i)
                    for k, v in (("piece", piece), ("start", at // 4), ("length", n), ("ids_crc32", zlib.crc32(body)), ("nth", int(seen[n]))):
                        out[k].append(v)
                    seen[n] += 1
            took = pa.array(row, pa.int64())
            made = {c: batch.column(j).take(took) for j, c in enumerate(columns)}
            made |= {"piece": pa.array(out["piece"], pa.int32()), "start": pa.array(out["start"], pa.int64()), "length": pa.array(out["length"], pa.int64())}
            made |= {"ids_crc32": pa.array(out["ids_crc32"], pa.int64()), "__part": pa.array([part] * len(row), pa.int32()), "__nth": pa.array(out["nth"], pa.int64())}
            yield pa.RecordBatch.from_pydict(made)

    return run


def document_pieces(df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, text: str = "text") -> DataFrame:
    """The pieces of each document (its ids, then id 0), cut at ``capacity``; all columns of ``df`` but ``text`` come along.

    A null or empty text is one piece of one id. Columns of ``df`` with the names of ``PIECES``, sequence_id, offset, __rank and __before are left out; other names do not clash.
    """
    new = [f.split()[0] for f in PIECES.split(", ")]
    keep = [c for c in df.columns if c not in (*new, "sequence_id", "offset", "__rank", "__before", text)]
    rows = df.select(*carried(keep), F.col(text).cast("string").alias("__text"))
    schema = fields(rows)[:-1] + [PIECES]
    return rows.mapInArrow(_pieces(tokenizer_path, capacity, inner(keep)), ", ".join(schema)).toDF(*keep, *new)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, times) that use every length as often as ``counts`` says; none sums to over ``capacity``."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    patterns: list[tuple[tuple[int, ...], int]] = []

    def use(pattern: tuple[int, ...]) -> None:
        need = Counter(pattern)
        times = int(min(left[k] // v for k, v in need.items()))
        if times:
            patterns.append((pattern, times))
            for k, v in need.items():
                left[k] -= v * times

    if left[capacity]:
        use((capacity,))
    for length in range(capacity - 1, 0, -1):
        if not left[length]:
            continue
        gap = capacity - length
        use((length, gap))
        there = np.flatnonzero(left[: gap + 1])
        for a in there[::-1]:  # pairs
            if not left[length]:
                break
            b = gap - int(a)
            if 0 < b <= a and left[a] and left[b]:
                use((length, int(a), b))
        for a in there[::-1]:  # triples: a single and a pair that fills what it leaves
            if not left[length]:
                break
            rest = gap - int(a)
            if rest < 2 or not left[a]:
                continue
            low = np.arange(1, rest // 2 + 1)
            for b in low[(left[low] > 0) & (left[rest - low] > 0)]:
                if not (left[length] and left[a]):
                    break
                use((length, int(a), rest - int(b), int(b)))
    patterns.extend(_best_fit(left, capacity))
    return patterns


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing over counts: equal bins are kept together with their number."""
    bins: list[dict[tuple[int, ...], int]] = [{} for _ in range(capacity + 1)]  # by free space
    for length in range(capacity, 0, -1):
        n = int(left[length])
        for room in range(length, capacity + 1):
            while n and bins[room]:
                pattern, times = bins[room].popitem()
                fit = room // length  # a bin takes as many as it can hold: it stays the best fit
                full, rest = divmod(n, fit)
                take = min(times, full)
                if take:
                    grown = pattern + (length,) * fit
                    target = bins[room - fit * length]
                    target[grown] = target.get(grown, 0) + take
                    n -= take * fit
                    times -= take
                if times and 0 < n < fit:
                    grown = pattern + (length,) * rest
                    target = bins[room - rest * length]
                    target[grown] = target.get(grown, 0) + 1
                    n, times = 0, times - 1
                if times:
                    bins[room][pattern] = bins[room].get(pattern, 0) + times
                    break
            if not n:
                break
        if n:
            fit = capacity // length
            full, rest = divmod(n, fit)
            for many, times in ((fit, full), (rest, 1)):
                if many and times:
                    grown = (length,) * many
                    bins[capacity - many * length][grown] = bins[capacity - many * length].get(grown, 0) + times
    return [x for free in bins for x in free.items()]


def _places(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, each sequence's places of that length, offset of the first)."""
    taken: Counter[int] = Counter()
    sequence, places = 0, []
    for pattern, times in patterns:
        offset = 0
        for length in sorted(set(pattern), reverse=True):
            per = pattern.count(length)
            places.append((length, taken[length], taken[length] + per * times, sequence, per, offset))
            taken[length] += per * times
            offset += per * length
        sequence += times
    return places


def _assign(places: list[tuple[int, int, int, int, int, int]], columns: list[str]):
    table = np.array(sorted(places), np.int64).reshape(-1, 6)
    bound = {int(k): (int(a), int(b)) for k, a, b in zip(*_runs(table[:, 0]), strict=True)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "__rank"))
            at = np.empty(len(length), np.int64)
            for k in np.unique(length):
                lo, hi = bound[int(k)]
                own = length == k
                at[own] = lo + np.searchsorted(table[lo:hi, 2], rank[own], side="right")
            place = table[at]
            within = rank - place[:, 1]
            made = {c: batch.column(c) for c in columns}
            made["sequence_id"] = pa.array(place[:, 3] + within // place[:, 4])
            made["offset"] = pa.array(place[:, 5] + within % place[:, 4] * length)
            yield pa.RecordBatch.from_pydict(made)

    return run


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    return keys[first], first, np.r_[first[1:], len(keys)] if len(keys) else first


def pack(df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, text: str = "text") -> DataFrame:
    """Each piece of each document with ``sequence_id`` and ``offset``: its place in a sequence of at most ``capacity`` tokens.

    Sequences are gapless from offset 0. Repeated rows are packed as often as they occur; an empty table gives an
    empty table. Columns: those of ``df`` but ``text``, piece, start, length, ids_crc32, sequence_id, offset.
    """
    pieces = materialise(document_pieces(df, tokenizer_path, capacity, text), "pieces")
    groups = materialise(pieces.groupBy("__part", "length").agg(F.count("*").alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.select("__part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    # A row for each task and length: it grows with the corpus, so it is never broadcast.
    ranked = pieces.join(starts.hint("merge"), ["__part", "length"]).withColumn("__rank", F.col("__nth") + F.col("__before"))
    keep = [c for c in pieces.columns if c not in ("__part", "__nth")]
    ranked = ranked.select(*carried(keep), "length", "__rank")
    schema = fields(ranked.drop("length", "__rank")) + ["sequence_id long", "offset long"]
    return ranked.mapInArrow(_assign(_places(plan(counts, capacity)), inner(keep)), ", ".join(schema)).toDF(*keep, "sequence_id", "offset")
