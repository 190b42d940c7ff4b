"""Operators over the lines of code blocks: what encloses a line, branches, closing of cut structures, empty shells, IF balance.

Lines are rows (keys, ln, raw); a block is a set of such rows. Every look for a neighbour is a window over one sort of each key's rows,
never a join of all lines with all spans. A line that is both a head and an end counts as neither.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depframe.functions import text as T
from depframe.operators import sequences as S
from depframe.session import materialise

LOOPS = ("FOR", "WHILE", "REPEAT")


def with_touched(spans: DataFrame, points: DataFrame, keys: list[str], at: str, low: Column, high: Column, name: str) -> DataFrame:
    """``spans`` with ``name``: whether a point lies in low..high, ends included. The next point from ``low`` on decides."""
    marked = spans.withColumns({"__at": low.cast("long"), "__high": high.cast("long"), "__span": F.lit(True)})
    both = marked.unionByName(points.select(*keys, F.col(at).cast("long").alias("__at")), allowMissingColumns=True)
    ahead = Window.partitionBy(*keys).orderBy("__at").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    both = both.withColumn("__next", F.min(F.when(F.col("__span").isNull(), F.col("__at"))).over(ahead)).where("__span")
    return both.withColumn(name, F.coalesce(F.col("__next") <= F.col("__high"), F.lit(False))).drop("__at", "__high", "__span", "__next")


def enclosing_span(points: DataFrame, spans: DataFrame, keys: list[str], at: str) -> DataFrame:
    """(keys, at, start, end): the innermost of properly nested spans strictly around each point.

    A point on the first or last line of any span is left out, one outside of all spans too. A point inside a span stands at the
    level of that span's start, so the last start at its level is the one.
    """
    edge = lambda c, step: spans.select(*keys, F.col(c).cast("long").alias("__at"), F.lit(step).alias("__step"))
    starts = spans.select(*keys, F.col("start").cast("long").alias("__at"), F.lit(1).alias("__step"), F.col("start").alias("__start"), F.col("end").alias("__end"))
    both = starts.unionByName(edge("end", -1), allowMissingColumns=True)
    both = both.unionByName(points.select(*keys, F.col(at).cast("long").alias("__at"), F.lit(0).alias("__step")).distinct(), allowMissingColumns=True)
    upto = Window.partitionBy(*keys).orderBy("__at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("__level", F.sum("__step").over(upto)).withColumn("__edge", F.max(F.abs("__step")).over(Window.partitionBy(*keys, "__at")))
    before = Window.partitionBy(*keys, "__level").orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumns({"start": F.last("__start", True).over(before), "end": F.last("__end", True).over(before)})
    return both.where("__step = 0 and __edge = 0 and __level > 0").select(*keys, F.col("__at").alias(at), "start", "end")


def construct_spans(lines: DataFrame, keys: list[str], word: str) -> DataFrame:
    """(keys, start, end): head and matching end of every IF, CASE, FOR, WHILE or REPEAT that is ended."""
    return all_spans(lines, keys, (word,)).drop("word")


def all_spans(lines: DataFrame, keys: list[str], words: tuple[str, ...]) -> DataFrame:
    """(keys, word, start, end): ``construct_spans`` of several words in one pass over the lines."""
    norm = F.col("__norm")

    def mark(word: str) -> Column:
        head = T.is_if_start(norm) if word == "IF" else norm.rlike(rf"^{word}\b")
        end = T.is_end_if(norm) if word == "IF" else norm.rlike(rf"\bEND_{word}\b")
        return F.struct(F.lit(word).alias("word"), head.cast("int").alias("__head"), end.cast("int").alias("__end"))

    rows = lines.select(*keys, "ln", T.norm_line(F.col("raw")).alias("__norm"))
    rows = rows.select(*keys, "ln", F.explode(F.array(*map(mark, words))).alias("__of")).where("__of.__head != __of.__end").select(*keys, "ln", "__of.*")
    return S.matching_end(rows, [*keys, "word"], "ln", "__head", "__end")


def if_branches(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, head, is_else, body_start, body_end, end): every branch of every ended IF; a body can be empty (start above end)."""
    norm = T.norm_line(F.col("raw"))
    rows = lines.select(*keys, "ln", norm.alias("norm"), norm.rlike(r"\bTHEN\b").alias("then"))
    rows = S.next_flag(rows.where(F.col("then") | F.col("norm").rlike("^(IF|ELSE|ELSIF)")), keys, "ln", "then", "header_end")
    spans = construct_spans(lines, keys, "IF")
    middles = enclosing_span(rows.where(T.is_elsif(F.col("norm")) | T.is_else(F.col("norm"))), spans, keys, "ln")
    heads = spans.select(*keys, "start", F.col("start").cast("long").alias("ln"), "end").unionByName(middles)
    heads = heads.join(rows.select(*keys, F.col("ln").cast("long").alias("ln"), T.is_else(F.col("norm")).alias("is_else"), "header_end"), [*keys, "ln"])
    by = Window.partitionBy(*keys, "start").orderBy("ln")
    body = F.when(F.col("is_else"), F.col("ln")).otherwise(F.coalesce("header_end", "ln")) + 1
    return heads.select(*keys, "start", F.col("ln").alias("head"), "is_else", body.alias("body_start"), (F.coalesce(F.lead("ln").over(by), "end") - 1).alias("body_end"), "end")


def same_level_else(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, else_ln, end): the first ELSE of every ended IF that has one."""
    return _elses(if_branches(lines, keys), keys)


def _elses(branches: DataFrame, keys: list[str]) -> DataFrame:
    return branches.where("is_else").groupBy(*keys, "start", "end").agg(F.min("head").alias("else_ln"))


def patched_ifs(hits: DataFrame, branches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ln): the hits, and the head and END_IF of every branch whose body holds one.

    A hit deep inside lies in the bodies of all branches around it, so one pass closes every level.
    """
    touched = with_touched(branches, hits, keys, "ln", F.col("body_start"), F.col("body_end"), "touched").where("touched")
    added = touched.select(*keys, F.explode(F.array(F.col("head").cast("long"), F.col("end").cast("long"))).alias("ln"))
    return hits.select(*keys, F.col("ln").cast("long").alias("ln")).union(added).distinct()


def patched_loops(hits: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ln): the hits, and of the innermost FOR, then WHILE, then REPEAT around each its header up to DO, or from UNTIL on, and its end.

    Lines that an earlier kind of loop added count as hits for a later one, not for their own kind. What each kind gives is written, so
    that no plan holds the ones before it: as one plan, Spark 4.1 lost rows unless ``spark.sql.unionOutputPartitioning`` was off.
    """
    norm = T.norm_line(F.col("raw"))
    rows = S.next_flag(lines.select(*keys, "ln", norm.alias("norm"), norm.rlike(r"\bDO\b").alias("do")), keys, "ln", "do", "header_end")
    got = hits.select(*keys, F.col("ln").cast("long").alias("ln")).distinct()
    for word in LOOPS:
        spans = construct_spans(lines, keys, word)
        around = enclosing_span(got, spans, keys, "ln").select(*keys, "start", "end").distinct()
        if word == "REPEAT":
            until = enclosing_span(rows.where(F.col("norm").rlike(r"^UNTIL\b")), spans, keys, "ln").groupBy(*keys, "start").agg(F.min("ln").alias("mid"))
            around = around.join(until, [*keys, "start"], "left")
            added = F.concat(F.array(F.col("start").cast("long")), F.sequence(F.coalesce("mid", "end").cast("long"), F.col("end").cast("long")))
        else:
            around = around.join(rows.select(*keys, F.col("ln").alias("start"), F.col("header_end").alias("mid")), [*keys, "start"])
            added = F.concat(F.sequence(F.col("start").cast("long"), F.coalesce("mid", "start").cast("long")), F.array(F.col("end").cast("long")))
        got = materialise(got.union(around.select(*keys, F.explode(added).alias("ln"))).distinct(), "loops")
    return got


def without_empty_shells(block: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """The block's lines without heads and ends of those spans that hold none of its lines but blank ones and comments. One pass: a shell of a shell stays."""
    return without_shells(block, [spans], keys)


def without_shells(block: DataFrame, passes: list[DataFrame], keys: list[str]) -> DataFrame:
    """``without_empty_shells`` for one table of spans after another: each pass sees what the ones before left. Spans may lack some of the keys and then are those of all blocks; their heads are lines that are neither blank nor comments.

    Heads and ends are marked by one join; a head goes if the next line that counts is its end or behind it, an end if the last one before is its head.
    """
    common = [k for k in keys if k in passes[0].columns]
    marked = lambda t, i, at, end, start: t.select(*common, F.col(at).alias("ln"), F.struct(F.lit(i).alias("nth"), end.cast("long").alias("end"), start.cast("long").alias("start")).alias("__m"))
    none = F.lit(None)
    marks = reduce(DataFrame.union, [m for i, t in enumerate(passes) for m in (marked(t, i, "start", F.col("end"), none), marked(t, i, "end", none, F.col("start")))])
    rows = block.join(marks.groupBy(*common, "ln").agg(F.collect_list("__m").alias("__marks")), [*common, "ln"], "left")
    by = Window.partitionBy(*keys).orderBy("ln")
    counts = F.when(T.is_substantive(F.col("raw")), F.col("ln"))
    rows = rows.withColumn("__counts", counts)
    for i in range(len(passes)):
        rows = rows.withColumns({"__next": F.min("__counts").over(by.rowsBetween(1, Window.unboundedFollowing)), "__before": F.max("__counts").over(by.rowsBetween(Window.unboundedPreceding, -1))})
        shell = lambda m: (m["nth"] == i) & ((m["end"].isNotNull() & (F.col("__next").isNull() | (F.col("__next") >= m["end"]))) | F.coalesce(m["start"] == F.col("__before"), F.lit(False)))  # noqa: B023, E731
        rows = rows.where(~F.coalesce(F.exists("__marks", shell), F.lit(False)))
    return rows.select(*block.columns)


def without_bare_cases(block: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """The block's lines without CASE and END_CASE where both are in it and the source has neither label nor ELSE between."""
    clean = T.clean_line(F.col("raw"))
    labels = lines.where(T.is_case_label(clean) | T.is_head(clean, "ELSE"))
    spans = with_touched(construct_spans(lines, keys, "CASE"), labels, keys, "ln", F.col("start") + 1, F.col("end") - 1, "labelled").where("not labelled")
    both = spans.join(block.select(*keys, F.col("ln").alias("start")), [*keys, "start"], "left_semi").join(block.select(*keys, F.col("ln").alias("end")), [*keys, "end"], "left_semi")
    return block.join(both.select(*keys, F.explode(F.array("start", "end")).alias("ln")), [*keys, "ln"], "left_anti").select(*block.columns)


def _if_marks(raw: Column) -> tuple[Column, Column, Column]:
    """(head, end, middle) of lines that hold nothing else."""
    middle = raw.rlike(r"(?i)^\s*ELSIF\b.*\bTHEN\b\s*$") | raw.rlike(r"(?i)^\s*ELSE\b\s*$")
    return raw.rlike(r"(?i)^\s*IF\b.*\bTHEN\b\s*$"), raw.rlike(r"(?i)^\s*END_IF\b\s*;?\s*$"), middle


def without_orphans(block: DataFrame, keys: list[str]) -> DataFrame:
    """The block's lines without END_IF, ELSE and ELSIF that no open IF precedes."""
    head, end, middle = _if_marks(F.col("raw"))
    rows = block.withColumns({"__head": head.cast("int"), "__end": end.cast("int"), "__middle": middle})
    rows = S.running_depth(rows, keys, ["ln"], "__end", "__head")
    before = F.lag("depth", 1, 0).over(Window.partitionBy(*keys).orderBy("ln"))
    return rows.withColumn("__before", before).where("not ((__end = 1 or __middle) and __before = 0)").select(*block.columns)


def if_balance(block: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, least, left_open, balanced): least and last depth of IFs; balanced where never below 0 and 0 at last."""
    head, end, _ = _if_marks(F.col("raw"))
    upto = Window.partitionBy(*keys).orderBy("ln").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = block.withColumn("__s", F.sum(head.cast("int") - end.cast("int")).over(upto))
    found = rows.groupBy(*keys).agg(F.least(F.min("__s"), F.lit(0)).alias("least"), F.max_by("__s", "ln").alias("left_open"))
    return found.withColumn("balanced", (F.col("least") >= 0) & (F.col("left_open") == 0))


def without_true_wrappers(block: DataFrame, keys: list[str]) -> DataFrame:
    """The block's lines without ``IF TRUE THEN`` and the END_IF of each, then without what that leaves orphaned: an ELSE of such a wrapper goes too, in the same step."""
    rows = without_orphans(block, keys)
    head, end, _ = _if_marks(F.col("raw"))
    spans = S.matching_end(rows.withColumns({"__head": head.cast("int"), "__end": end.cast("int")}), keys, "ln", "__head", "__end")
    wrappers = rows.where(head & F.upper(F.ltrim("raw")).startswith("IF TRUE THEN")).select(*keys, F.col("ln").alias("start")).join(spans, [*keys, "start"], "left")
    gone = wrappers.select(*keys, F.explode(F.array("start", "end")).alias("ln")).where("ln is not null")
    return without_orphans(rows.join(gone, [*keys, "ln"], "left_anti").select(*block.columns), keys)


def with_single_blanks(block: DataFrame, keys: list[str]) -> DataFrame:
    """The block's lines without blank ones that follow a blank one."""
    blank = F.col("raw").rlike(r"^\s*$")
    before = F.lag(blank, 1, False).over(Window.partitionBy(*keys).orderBy("ln"))
    return block.withColumn("__twice", blank & before).where("not __twice").drop("__twice")


def folded_half_ifs(block: DataFrame, lines: DataFrame, keys: list[str], heads: DataFrame | None = None) -> DataFrame:
    """(keys, ln, raw): IFs with ELSE of which the source fills one side only lose their ELSE; an empty THEN also turns the condition round.

    ``heads`` are the branches of the source, where they are at hand. Both may lack some of the keys and then are those of all blocks: which sides the source fills is found once, not for each block. The side that is filled must have lines in the block. A header of several lines becomes one where it is turned round.
    """
    common = [k for k in keys if k in lines.columns]
    heads = if_branches(lines, common) if heads is None else heads
    ifs = heads.where("head = start").select(*common, "start", "body_start").join(_elses(heads, common), [*common, "start"])
    source = lines.where(T.is_substantive(F.col("raw")))
    then, other = (F.col("body_start"), F.col("else_ln") - 1), (F.col("else_ln") + 1, F.col("end") - 1)
    for name, (low, high) in (("then_src", then), ("else_src", other)):
        ifs = with_touched(ifs, source, common, "ln", low, high, name)
    ifs = ifs.where("then_src != else_src").join(block.select(*keys, F.col("ln").alias("start")), [*common, "start"])
    for name, (low, high) in (("then_blk", then), ("else_blk", other)):
        ifs = with_touched(ifs, block, keys, "ln", low, high, name)
    turned, dropped = F.expr("not then_src and else_src and else_blk"), F.expr("then_src and not else_src and then_blk")
    ifs = materialise(ifs.withColumn("turned", turned).where(turned | dropped), "half-ifs")
    spread = F.when(F.col("turned"), F.sequence(F.col("start").cast("long"), F.col("body_start").cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))
    header = ifs.where("turned").select(*keys, "start", F.explode(spread).alias("ln")).join(lines.select(*common, F.col("ln").cast("long").alias("ln"), "raw"), [*common, "ln"])
    header = S.rendered(header, [*keys, "start"], ["ln"], F.col("raw"), "text", " ").select(*keys, F.col("start").alias("ln"), F.concat(F.lit("IF NOT ("), T.if_condition(F.col("text")), F.lit(") THEN")).alias("__raw"))
    inner = F.filter(spread, lambda x: x > F.col("start"))
    gone = ifs.select(*keys, F.explode(F.concat(inner, F.array(F.col("else_ln").cast("long")))).alias("ln"))
    kept = block.join(gone, [*keys, "ln"], "left_anti").join(header, [*keys, "ln"], "left")
    return kept.select(*keys, "ln", F.coalesce("__raw", "raw").alias("raw"))
