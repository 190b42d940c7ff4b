"""Suffix-array dedup: repeated passages found through a logarithmic family of suffix-array levels.

Every ``LENGTH``-byte window of a text contains an anchor, the place of the least hash among its
``ANCHOR``-byte stretches; equal windows have their anchors at equal distance. Suffixes that begin at anchors are
therefore the only ones an index needs: about one in 35. A level is the array of those suffixes, sorted by the hash of the anchor
(``a``) and of the whole stretch of windows that the anchor serves (``s``), with the earliest place of each. Sorting by
hashes in place of bytes brings equal beginnings together just the same, which is all that a merge scan asks.

A new batch of documents is cut into such suffixes, brought into order together with the existing levels by one exchange and sort, and
scanned once. Equal (a, s) means that all the stretch's windows repeat. Equal a with different s may
share some windows: those stretches are contested, and one representative of each goes, with its bytes, into a last comparison of
the windows of equal anchors. Levels of one rank merge as in a binary counter: the scan writes the batch and the levels that merge with it as one array,
and leaves larger levels alone.

Hot passages: copies within a slice of text are reduced to the earliest at once. An anchor that meets ``HOT``
different stretches in a slice, as in a line that very many documents share, has its windows compared one by one, dealt by their own
hashes; only a mark goes to its sorted group. So a group holds few rows for each slice, however common its passage. A sorted group that still
grows past ``HELD`` rows is scanned in parts, of which each hands its last beginning on to the next; with over ``CROWD`` different stretches it counts as hot.
No task therefore holds a whole group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depframe.llm.byte_hashing import PrefixHash, slices, text_bytes
from depframe.llm.columns import carried, fields, inner, rows_at_a_time
from depframe.session import materialise, scratch_path, shuffle_files_cleaned

LENGTH, ANCHOR, HOT = 100, 32, 16
#: Window starts worked on at a time within one text, rows of one anchor scanned at a time, stretches of one anchor compared in a group, windows compared at
#: a time, and texts that a Python worker gets at a time; they bound memory and change no result.
BLOCK, HELD, CROWD, COMPARED, TEXT_ROWS = 1 << 20, 1 << 16, 1024, 1 << 18, 1000
ENTRY, REPEAT, MARK, WINDOW, CONTEST, HOT_CONTEST, STRETCH = range(7)
ROWS = "kind int, a long, s long, doc long, at long, n int"
_FIELDS = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("s", pa.int64()), ("doc", pa.int64()), ("at", pa.int64()), ("n", pa.int32())])
#: A null key comes after all others.
LAST = (1 << 63) - 1


def _rows(kind, a, s, doc, at, n) -> pa.RecordBatch:
    size = len(doc)
    wide = lambda x: np.broadcast_to(np.asarray(x), size)
    columns = [wide(kind).astype(np.int32), *(np.ascontiguousarray(wide(x)).view(np.int64) for x in (a, s)), doc, at, wide(n).astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_FIELDS)


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours, by doubling."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def _stretches(data: np.ndarray, offsets: np.ndarray, length: int, anchor: int, block: int) -> Iterator[tuple]:
    """For blocks of texts: (hashers, first byte of each stretch in the block, its windows, anchor hash, text number, place in the text)."""
    for lo in range(0, max(1, len(data)), block):
        part = data[lo : lo + block + length - 1]
        if len(part) < length:
            return
        h, g = PrefixHash(part, 0), PrefixHash(part, 1)
        grams = h.every(anchor)
        place = np.arange(len(grams), dtype=np.uint64)
        least = _sliding_least((grams & ~np.uint64(0xFFFFFF)) | place, length - anchor + 1)
        where = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        owner = np.searchsorted(offsets, np.arange(lo, lo + len(part)), side="right") - 1 if len(offsets) < 3 else _owners(offsets, lo, len(part))
        whole = owner[: len(where)] == owner[length - 1 :]
        turn = np.r_[True, (where[1:] != where[:-1]) | (owner[1 : len(where)] != owner[: len(where) - 1])]
        start = whole & (turn | ~np.r_[False, whole[:-1]])
        first = np.flatnonzero(start)
        if len(first):
            last = np.flatnonzero(whole & np.r_[start[1:] | ~whole[1:], True])
            text = owner[first]
            yield h, g, first, last - first + 1, grams[where[first]], text, first + lo - offsets[text]


def _owners(offsets: np.ndarray, lo: int, n: int) -> np.ndarray:
    ends = np.clip(offsets - lo, 0, n)
    return np.repeat(np.arange(len(offsets) - 1), np.diff(ends))


def _windows(h, g, first, count, doc, at, length) -> tuple[np.ndarray, ...]:
    """The windows of stretches: two hashes, document and place of each."""
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    begin = np.repeat(first, count) + step
    return h(begin, begin + length), g(begin, begin + length), np.repeat(doc, count), np.repeat(at, count) + step


def _split_earliest(x, y, doc, at) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the earliest place of each (x, y), and of later ones; places that are the earliest's own are in neither."""
    order = np.lexsort((at, doc, y, x))
    x, y, doc, at = x[order], y[order], doc[order], at[order]
    new = np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])] if len(x) else np.zeros(0, bool)
    head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(x) else np.zeros(0, int)
    later = (doc != doc[head]) | (at != at[head])
    return order[new], order[~new & later]


def _suffixes(length: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            ids = batch.column("doc").to_numpy(zero_copy_only=False)
            for lo, hi in slices(offsets):
                own = offsets[lo : hi + 1] - offsets[lo]
                for h, g, first, count, a, text, at in _stretches(data[offsets[lo] : offsets[hi]], own, length, anchor, BLOCK):
                    doc = ids[lo + text]
                    s = g(first, first + count + length - 1)
                    keep, later = _split_earliest(a, s, doc, at)
                    if len(later):
                        yield _rows(REPEAT, a[later] + np.uint64(1) * at[later].astype(np.uint64), s[later], doc[later], at[later], count[later])
                    _, group, size = np.unique(a[keep], return_inverse=True, return_counts=True)
                    hot = size[group] >= HOT
                    calm, hot = keep[~hot], keep[hot]
                    if len(hot):
                        x, y, wdoc, wat = _windows(h, g, first[hot], count[hot], doc[hot], at[hot], length)
                        w, again = _split_earliest(x, y, wdoc, wat)
                        yield _rows(WINDOW, x[w], y[w], wdoc[w], wat[w], 1)
                        if len(again):
                            yield _rows(REPEAT, x[again], y[again], wdoc[again], wat[again], 1)
                        marks = np.unique(a[hot])
                        yield _rows(MARK, marks, 0, np.full(len(marks), -LAST), np.zeros(len(marks), np.int64), 0)
                    yield _rows(ENTRY, a[calm], s[calm], doc[calm], at[calm], count[calm])

    return run


def _last_beginning(t: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The earliest row of the last (s, kind) among rows of one anchor; windows and single repeats have been passed on and count for nothing here."""
    own = np.flatnonzero((t["kind"] != REPEAT) & (t["kind"] != WINDOW))
    if not len(own):
        return {c: x[:0] for c, x in t.items()}
    s, kind = t["s"][own], t["kind"][own]
    other = np.flatnonzero((s != s[-1]) | (kind != kind[-1]))
    first = own[other[-1] + 1 if len(other) else 0]
    return {c: x[first : first + 1] for c, x in t.items()}


def _merge_scan(keep_level: bool):
    """Over rows in the order of (a, s, doc, at): new level entries, repeats and contested stretches. ``fresh``: of the batch; ``merging``: to be written."""

    def scan(t: dict[str, np.ndarray], part: bool = False) -> Iterator[pa.RecordBatch]:
        passed = (t["kind"] == REPEAT) | (t["kind"] == WINDOW)
        yield _rows(*(t[c][passed] for c in _FIELDS.names))
        a, s, doc, at, n, fresh, merging, kind = (t[c][~passed] for c in ("a", "s", "doc", "at", "n", "fresh", "merging", "kind"))
        if not len(a):
            return
        entry = kind == ENTRY
        new_a = np.r_[True, a[1:] != a[:-1]]
        new = np.r_[True, new_a[1:] | (s[1:] != s[:-1]) | (kind[1:] != kind[:-1])]
        group = np.cumsum(new_a) - 1
        contested = np.bincount(group, new) > 1
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        repeat = entry & fresh & ~new & ((doc != doc[head]) | (at != at[head]))
        yield _rows(REPEAT, a[repeat], s[repeat], doc[repeat], at[repeat], n[repeat])
        fought = entry & new & contested[group]
        marked = (np.bincount(group, kind == MARK) > 0) | (np.bincount(group, new) > CROWD) | part
        yield _rows(np.where(marked[group[fought]], HOT_CONTEST, CONTEST), a[fought], s[fought], doc[fought], at[fought], n[fought])
        if keep_level:
            stay = new & merging
            yield _rows(kind[stay], a[stay], s[stay], doc[stay], at[stay], n[stay])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = (*_FIELDS.names, "fresh", "merging")
        held: dict[str, np.ndarray] | None = None
        for batch in batches:
            t = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
            if held is not None:
                t = {c: np.concatenate([held[c], t[c]]) for c in names}
            cut = int(np.searchsorted(t["a"], t["a"][-1])) if len(t["a"]) else 0  # the last group may go on
            held = {c: t[c][cut:] for c in names}
            if cut:
                yield from scan({c: t[c][:cut] for c in names})
            if len(held["a"]) > HELD:
                # What comes next repeats the last beginning or contests it: its earliest place goes on, and where it is found twice that adds nothing.
                yield from scan(held, part=True)
                held = _last_beginning(held)
        if held is not None and len(held["a"]):
            yield from scan(held)

    return run


class SuffixLevels:
    """A family of suffix-array levels over the documents added so far, each a Parquet table in the shared folder."""

    def __init__(self, spark: SparkSession, length: int = LENGTH, anchor: int = ANCHOR):
        self.spark, self.length, self.anchor = spark, length, anchor
        self.levels: list[tuple[int, str]] = []  # (rank, path), largest rank first

    def add(self, docs: DataFrame, last: bool = False) -> DataFrame:
        """Scan a batch (doc, text) against all levels and itself; rows of kinds REPEAT, WINDOW, CONTEST and HOT_CONTEST.

        Documents of a batch must not come before those of earlier batches. ``last``: no batch follows, so no level is written.
        """
        merging, rank = [], 0
        while self.levels and self.levels[-1][0] == rank and not last:
            merging.append(self.levels.pop())
            rank += 1
        batch = docs.mapInArrow(_suffixes(self.length, self.anchor), ROWS).withColumns({"fresh": F.lit(True), "merging": F.lit(True)})
        for paths, flag in (([p for _, p in merging], True), ([p for _, p in self.levels], False)):
            for p in paths:
                batch = batch.unionByName(self.read(p).withColumns({"fresh": F.lit(False), "merging": F.lit(flag)}))
        ordered = batch.repartition("a").sortWithinPartitions("a", "s", "kind", "doc", "at")
        out = scratch_path(self.spark, "suffix-level")
        with shuffle_files_cleaned(self.spark), rows_at_a_time(self.spark, TEXT_ROWS):
            ordered.mapInArrow(_merge_scan(not last), ROWS).write.parquet(out)
        found = self.spark.read.schema(ROWS).parquet(out).where(F.col("kind").isin(REPEAT, WINDOW, CONTEST, HOT_CONTEST))
        if last:
            return found
        found = materialise(found, "suffix-found")
        self.levels.append((rank, out))
        for _, p in merging:
            _remove(self.spark, p)
        return found

    def read(self, path: str) -> DataFrame:
        return self.spark.read.schema(ROWS).parquet(path).where(F.col("kind").isin(ENTRY, MARK))

    def drop(self) -> None:
        for _, p in self.levels:
            _remove(self.spark, p)
        self.levels = []


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a table that this module wrote and no longer needs."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


STRETCHES = f"{ROWS}, bytes binary"


def _contested_stretches(length: int):
    """The bytes of contested stretches; of those with a marked anchor, the windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bare = lambda rows: rows.append_column(pa.field("bytes", pa.binary()), pa.nulls(rows.num_rows, pa.binary()))
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            ids = batch.column("doc").to_numpy(zero_copy_only=False)
            spans = batch.column("spans")
            bounds = spans.offsets.to_numpy()
            flat = spans.flatten()
            begin, count, anchor, hot = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            count = count.astype(np.int64)
            base = bounds[0]
            for lo, hi in slices(offsets):
                part = data[offsets[lo] : offsets[hi]]
                chosen = slice(bounds[lo] - base, bounds[hi] - base)
                text = np.repeat(np.arange(lo, hi), np.diff(bounds[lo : hi + 1]))
                b, n, a, marked = begin[chosen], count[chosen], anchor[chosen], hot[chosen].astype(bool)
                fits = b + n + length - 1 <= (offsets[text + 1] - offsets[text])  # another row may share the key
                b, n, a, marked, text = b[fits], n[fits], a[fits], marked[fits], text[fits]
                first = b + offsets[text] - offsets[lo]
                calm = np.flatnonzero(~marked)
                if len(calm):
                    body = pa.array([part[x : x + k].tobytes() for x, k in zip(first[calm].tolist(), (n[calm] + length - 1).tolist())], pa.binary())
                    yield _rows(STRETCH, a[calm], 0, ids[text[calm]], b[calm], n[calm]).append_column("bytes", body)
                if marked.any():
                    h, g = PrefixHash(part, 0), PrefixHash(part, 1)
                    x, y, doc, at = _windows(h, g, first[marked], n[marked], ids[text[marked]], b[marked], length)
                    w, again = _split_earliest(x, y, doc, at)
                    yield bare(_rows(WINDOW, x[w], y[w], doc[w], at[w], 1))
                    yield bare(_rows(REPEAT, x[again], y[again], doc[again], at[again], 1))

    return run


def _compare(length: int):
    """Over stretches in the order of their anchors: runs of windows that an earlier stretch of the anchor has too."""

    def compared(t: pa.Table) -> pa.RecordBatch:
        data = np.frombuffer(b"".join(t["bytes"].to_pylist()), np.uint8)
        doc, at, n = (t[c].to_numpy() for c in ("doc", "at", "n"))
        n = n.astype(np.int64)
        size = n + length - 1
        first = np.cumsum(size) - size
        x, y, wdoc, wat = _windows(PrefixHash(data, 0), PrefixHash(data, 1), first, n, doc, at, length)
        _, later = _split_earliest(x, y, wdoc, wat)
        later.sort()
        stretch = np.repeat(np.arange(len(n)), n)[later]
        new = np.r_[True, (later[1:] != later[:-1] + 1) | (stretch[1:] != stretch[:-1])][: len(later)]
        begin = np.flatnonzero(new)
        runs = np.diff(np.r_[begin, len(later)])
        some = later[begin]
        return _rows(REPEAT, x[some], y[some], wdoc[some], wat[some], runs)

    def pieces(t: pa.Table) -> Iterator[pa.RecordBatch]:
        """Whole anchors, of about ``COMPARED`` windows together, one anchor at least."""
        a, upto = t["a"].to_numpy(), np.cumsum(t["n"].to_numpy().astype(np.int64))
        ends = np.r_[np.flatnonzero(a[1:] != a[:-1]) + 1, len(a)]
        lo = 0
        while lo < len(a):
            room = int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + COMPARED, side="right"))
            fit = ends[(ends > lo) & (ends <= room)]
            hi = int(fit[-1] if len(fit) else ends[np.searchsorted(ends, lo, side="right")])
            yield compared(t.slice(lo, hi - lo))
            lo = hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            a = held["a"].to_numpy()
            cut = int(np.searchsorted(a, a[-1])) if len(a) else 0  # the last anchor may go on
            if cut:
                yield from pieces(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from pieces(held)

    return run


def repeated_windows(docs: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """(doc, at, n) of all stretches of n windows that repeat an earlier one, once contested stretches are settled."""
    places = found.where(F.col("kind").isin(CONTEST, HOT_CONTEST)).groupBy("doc", "at", "n", "a").agg(F.max("kind").alias("kind"))
    hot = places.where(F.col("kind") == HOT_CONTEST).select("a").distinct().withColumn("hot", F.lit(True))
    places = places.join(hot, "a", "left").select("doc", "at", F.col("n").cast("long").alias("n"), "a", F.coalesce("hot", F.lit(False)).alias("hot"))
    spans = places.groupBy("doc").agg(F.collect_list(F.struct("at", "n", "a", "hot")).alias("spans"))
    settled = docs.join(spans, "doc").select("doc", "text", "spans").mapInArrow(_contested_stretches(length), STRETCHES)
    with rows_at_a_time(docs.sparkSession, TEXT_ROWS):
        settled = materialise(settled, "suffix-contested")
    calm = settled.where(F.col("kind") == STRETCH).select("a", "doc", "at", "n", "bytes")
    fought = calm.repartition("a").sortWithinPartitions("a", "doc", "at").mapInArrow(_compare(length), ROWS)
    both = settled.select(*found.columns).unionByName(found)
    windows = both.where(F.col("kind") == WINDOW).select("a", "s", "doc", "at")
    earliest = windows.groupBy("a", "s").agg(F.min(F.struct("doc", "at")).alias("e"), F.count("*").alias("c")).where("c > 1").select("a", "s", "e")
    later = windows.join(earliest, ["a", "s"]).where((F.col("doc") != F.col("e.doc")) | (F.col("at") != F.col("e.at")))
    sure = both.where(F.col("kind") == REPEAT).unionByName(fought).select("doc", "at", "n")
    return sure.unionByName(later.select("doc", "at", F.lit(1).alias("n")))


def _cut(length: int, whole_characters: bool, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, TEXT_ROWS) for b in batches for lo in range(0, b.num_rows, TEXT_ROWS)):
            data, offsets = text_bytes(batch.column("__text"))
            spans = batch.column("__spans")
            flat, bounds = spans.flatten(), spans.offsets.to_numpy()
            begin, count = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
            base, valid = bounds[0], spans.is_valid().to_numpy(zero_copy_only=False)
            kept, removed, runs = [], [], []
            for i in range(batch.num_rows):
                text = data[offsets[i] : offsets[i + 1]]
                some = slice(bounds[i] - base, bounds[i + 1] - base)
                if not valid[i] or some.start == some.stop:
                    kept.append(text.tobytes())
                    removed.append(0)
                    runs.append(0)
                    continue
                edge = np.zeros(len(text) + 1, np.int64)
                np.add.at(edge, np.minimum(begin[some], len(text)), 1)
                np.add.at(edge, np.minimum(begin[some] + count[some] + length - 1, len(text)), -1)
                gone = np.cumsum(edge[:-1]) > 0
                if whole_characters:
                    character = np.cumsum((text & 0xC0) != 0x80) - 1
                    partly = np.bincount(character, ~gone) > 0
                    gone &= ~partly[character]
                kept.append(text[~gone].tobytes())
                removed.append(int(gone.sum()))
                runs.append(int((gone & ~np.r_[False, gone[:-1]]).sum()))
            made = {c: batch.column(c) for c in columns}
            made |= {"n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(runs, pa.int64()), "kept": pa.array(kept, pa.binary())}
            yield pa.RecordBatch.from_pydict(made)

    return run


def suffix_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, batches: int = 3, whole_characters: bool = False) -> DataFrame:
    """``df`` without ``text``, with n_bytes, n_removed, n_spans and kept (bytes): each text less every byte that a repeated window covers.

    A window of ``length`` bytes repeats if an equal one starts earlier: in a row of smaller key, or in the same row at an
    earlier byte. All are judged on the input. Null texts count as empty; null keys come last. Rows of one key at one place are not earlier than one
    another. With ``whole_characters`` a character stays whole if any byte of it does. Documents are added in ``batches`` ranges of the key.
    Columns of the new names are replaced and columns ``__text``, ``__spans`` and ``__doc`` left out; an empty table gives an empty table.
    """
    spark = df.sparkSession
    if not ANCHOR <= length - 8:
        raise ValueError(f"windows of under {ANCHOR + 8} bytes have no room for anchors")
    docs = df.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    cuts = df.agg(F.percentile_approx(F.col(key).cast("long"), [i / batches for i in range(1, batches)], 10_000)).first()[0] if batches > 1 else []
    cuts = [-LAST - 1, *sorted(set(cuts or [])), LAST]
    family, found = SuffixLevels(spark, length), None
    for i, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False)):
        final = high == LAST
        some = docs.where((F.col("doc") >= low) & ((F.col("doc") <= high) if final else (F.col("doc") < high)))
        new = family.add(some, last=final)
        found = new if found is None else found.unionByName(new)
    family.drop()
    repeats = repeated_windows(docs, found, length)
    with rows_at_a_time(spark, TEXT_ROWS):
        repeats = materialise(repeats, "suffix-repeats")
    spans = repeats.groupBy("doc").agg(F.collect_list(F.struct("at", "n")).alias("__spans"))
    new = ("n_bytes", "n_removed", "n_spans", "kept", "__text", "__spans", "__doc")
    keep = [c for c in df.columns if c not in (*new, text)]
    rows = df.select(*carried(keep), F.col(text).cast("string").alias("__text"), F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("__doc"))
    rows = rows.join(spans.withColumnRenamed("doc", "__doc"), "__doc", "left").select(*inner(keep), "__text", "__spans")
    schema = fields(rows.select(*inner(keep))) + ["n_bytes long", "n_removed long", "n_spans long", "kept binary"]
    return rows.mapInArrow(_cut(length, whole_characters, inner(keep)), ", ".join(schema)).toDF(*keep, *new[:4])
