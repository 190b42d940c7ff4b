"""Line dedup: lines that stand in many documents go, wherever they stand.

Only DataFrame functions are used. Every line becomes a row of two hashes of its key, its document and its place. The rows are dealt by ranges of
(hash, document) and sorted by place within, so a hash that a third of all lines share spans many tasks, and a window over (hash, document)
streams the first occurrences without another exchange. Counts of first occurrences, summed in every task before they are
shuffled, tell which hashes are frequent. What comes back for a document is no text but its keep bitmap: one bit for each line
in words of 64, of which words that keep all lines are only counted.

The decision goes back to the rows by two joins: hashes in over one part in ``HEAVY`` of all (document, hash) pairs, at most ``HEAVY`` of them,
are broadcast; all others are too rare to fill a task and join by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depframe.session import discard, materialise

#: Fixed values. What is stripped from both ends of a line; the letters that are lower-cased.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most hashes that are broadcast (16 bytes each); it changes no result.
HEAVY = 2000
WORD = 64
HASH = ["h1", "h2"]


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, other letters as they are; for ASCII texts the faster built-in does the same."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _document(key: str, text: str) -> list[Column]:
    """What names a document: its key and a digest of its text, so rows of one key and other texts stay apart."""
    return [F.col(f"`{key}`").alias("id"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("digest")]


def line_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(h1, h2, id, digest, pos, first): every line with a key, sorted within ranges of (hash, document); first marks a hash's first line in its document."""
    held = df.select(*_document(key, text), ascii_lower(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("t"))
    keys = F.transform(F.split("t", "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)))
    lines = held.select("id", "digest", F.posexplode(keys).alias("pos", "key")).where("key != ''")
    hashed = lines.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "id", "digest", "pos")
    by = [*HASH, "id", "digest"]
    placed = hashed.repartitionByRange(*by)
    first = F.row_number().over(Window.partitionBy(*by).orderBy("pos")) == 1
    return placed.withColumn("first", first)


def frequent_lines(rows: DataFrame, least: int) -> DataFrame:
    """(h1, h2, n): hashes in at least ``least`` documents."""
    return rows.where("first").groupBy(*HASH).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def keep_bitmaps(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = 10) -> DataFrame:
    """(id, digest, keep, n_dropped): a row for every document that loses a line.

    ``keep`` is an array of (full, bits): ``full`` words of 64 lines that are all kept, then a word whose bit i tells whether its line i is.
    Lines after the last word are kept.
    """
    rows = materialise(line_rows(df, key, text), "lines")
    frequent = materialise(frequent_lines(rows, least), "frequent-lines")
    pairs = rows.where("first").count()
    heavy = F.col("n") * HEAVY > F.lit(pairs)
    dropped = rows.join(F.broadcast(frequent.where(heavy).select(*HASH)), HASH, "left_semi")  # at most HEAVY rows: each holds over 1 / HEAVY of all pairs
    rest = rows.join(frequent.where(~heavy).select(*HASH), HASH, "left_semi")
    dropped = dropped.union(rest).select("id", "digest", F.floor(F.col("pos") / WORD).cast("int").alias("word"), F.expr(f"shiftleft(1L, pos % {WORD})").alias("bit"))
    words = dropped.groupBy("id", "digest", "word").agg(F.bit_or("bit").alias("gone"))
    maps = words.groupBy("id", "digest").agg(F.array_sort(F.collect_list(F.struct("word", "gone"))).alias("words"), F.sum(F.bit_count("gone")).cast("long").alias("n_dropped"))
    before = lambda i: F.coalesce(F.get("words", i - 1)["word"], F.lit(-1))
    keep = F.transform("words", lambda x, i: F.struct((x["word"] - before(i) - 1).alias("full"), F.bitwise_not(x["gone"]).alias("bits")))
    out = materialise(maps.select("id", "digest", keep.alias("keep"), "n_dropped"), "keep-bitmaps")
    discard(rows, frequent)
    return out


def kept_text(text: Column, keep: Column) -> Column:
    """The lines of ``text`` whose bit in ``keep`` is set, joined by line feeds."""
    dense = F.flatten(F.transform(keep, lambda x: F.concat(F.array_repeat(F.lit(-1).cast("long"), x["full"]), F.array(x["bits"]))))
    # Both arrays are in one struct, so that the words are spread out once for a text and not once for each line.
    both = F.transform(F.array(F.struct(F.split(text, "\n", -1).alias("lines"), dense.alias("words"))), lambda b: F.filter(b["lines"], lambda x, i: _kept(b["words"], i)))
    return F.array_join(both[0], "\n")


def _kept(words: Column, i: Column) -> Column:
    word = F.coalesce(F.get(words, F.floor(i / WORD).cast("int")), F.lit(-1).cast("long"))
    return F.call_function("getbit", word, i % WORD) == 1


def line_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = 10) -> DataFrame:
    """``df`` with a struct column ``lines``: n_lines, n_dropped and kept, the text without lines that at least ``least`` documents have.

    Texts are split at line feeds; null counts as empty, which is one empty line. A line's key is the line without blanks at both ends, A-Z
    lower-cased; a line of blanks only has no key and always stays. Rows of one key and one text are one document, so repeated rows
    do not make a line frequent; rows of one key and other texts are several, and a null key is a key like any other. Every row
    of ``df`` gives one row with all its columns, whatever their names; a column ``lines`` is replaced. An empty table gives an empty one.
    """
    own = [c for c in df.columns if c != "lines"]
    maps = keep_bitmaps(df, key, text, least)
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    held = df.select(*_document(key, text), t.alias("t"), F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"))
    found = maps.select(F.col("id").alias("m_id"), F.col("digest").alias("m_digest"), "keep", "n_dropped")
    joined = held.join(found, F.col("id").eqNullSafe(F.col("m_id")) & (F.col("digest") == F.col("m_digest")), "left")
    n_lines = (F.length("t") - F.length(F.replace("t", F.lit("\n"), F.lit(""))) + 1).cast("long")
    kept = F.when(F.col("keep").isNull(), F.col("t")).otherwise(kept_text(F.col("t"), F.col("keep")))
    out = F.struct(n_lines.alias("n_lines"), F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"), kept.alias("kept"))
    return joined.select("row.*", out.alias("lines"))
