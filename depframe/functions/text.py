"""Scalar functions over Structured Text sources and their lines: cleaning, predicates and rendering helpers.

Patterns are ASCII, as Java's ``\\b`` and ``\\w`` are: identifiers with other letters are taken letter by letter.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values. What splits lines, all of the characters that Python's splitlines knows.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
HEADS = ("IF", "FOR", "CASE", "WHILE", "REPEAT")
BLOCK_COMMENT = r"(?s)\(\*.*?\*\)"


def unescape_entities(source: Column) -> Column:
    """The entities that sources carry, ``&amp;`` last, and line ends as line feeds."""
    for entity, character in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        source = F.replace(source, F.lit(entity), F.lit(character))
    return F.regexp_replace(source, r"\r\n?", "\n")


def split_lines(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """(keep, ln, raw): the lines of a text from 1 on. A last line break ends its line and begins none; an empty text has no lines."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(F.regexp_replace(t, f"({LINE_BREAK})$(?![\\s\\S])", ""), LINE_BREAK, -1)
    return df.where(F.length(t) > 0).select(*keep, F.posexplode(lines).alias("ln", "raw")).withColumn("ln", F.col("ln") + 1)


def slicer_source(source: Column) -> Column:
    """What the slicer parses: two entities back, block comments as one blank, empty outputs filled in."""
    source = F.replace(F.replace(source, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">"))
    source = F.regexp_replace(source, BLOCK_COMMENT, " ")
    return F.regexp_replace(source, r"=>\s*(?=[,)])", "=> __dummy__")


def describer_source(source: Column) -> Column:
    """What the describer parses: also without pragmas and line comments, blanks and blank lines squeezed."""
    source = F.regexp_replace(slicer_source(F.regexp_replace(source, r"\r\n?", "\n")), r"(?s)\{.*?\}", " ")
    source = F.regexp_replace(F.regexp_replace(source, r"//[^\n]*", ""), r"[ \t]+", " ")
    return F.regexp_replace(source, r"\n\s*\n+", "\n")


def without_block_comments(source: Column) -> Column:
    return F.regexp_replace(source, BLOCK_COMMENT, "")


def clean_line(line: Column) -> Column:
    """A line without comments: the rest after ``//`` goes before ``(* *)`` does."""
    return F.regexp_replace(F.regexp_replace(line, r"//.*", ""), r"\(\*.*?\*\)", "")


def norm_line(line: Column) -> Column:
    """Upper case without comments and outer blanks; here ``(* *)`` goes before the rest after ``//`` does."""
    bare = F.regexp_replace(F.regexp_replace(line, r"\(\*.*?\*\)", ""), r"//.*", "")
    return F.upper(F.regexp_replace(bare, r"^\s+|\s+$", ""))


def is_head(line: Column, word: str) -> Column:
    return line.rlike(rf"(?i)^\s*{word}\b")


def is_if_start(norm: Column) -> Column:
    """Only with a blank after it, so ``IF(`` is none."""
    return norm.startswith("IF ")


def is_elsif(norm: Column) -> Column:
    return norm.startswith("ELSIF ")


def is_else(norm: Column) -> Column:
    return (norm == "ELSE") | norm.startswith("ELSE ")


def is_end_if(norm: Column) -> Column:
    return norm.startswith("END_IF")


def is_case_label(line: Column) -> Column:
    """A colon that no assignment follows, on a line without any assignment."""
    return line.rlike(r":([^=]|$)") & ~line.contains(":=")


def is_substantive(line: Column) -> Column:
    return norm_line(line) != ""


def depth_delta(line: Column) -> tuple[Column, Column]:
    """(ends, heads) of a cleaned line: ends count wherever they stand, a head only where the line begins."""
    ends = F.regexp_count(F.upper(line), F.lit(r"\bEND_(IF|CASE|FOR|WHILE|REPEAT)\b"))
    heads = F.when(line.rlike(rf"(?i)^\s*({'|'.join(HEADS)})\b"), 1).otherwise(0)
    return ends, heads


def is_executable(line: Column) -> Column:
    """For block cleaning: an assignment, a call, RETURN, EXIT or CONTINUE on a line that is no head or end of an IF, no declaration and no comment.

    Heads of loops count where they assign or call.
    """
    text = F.regexp_replace(line, r"^\s+|\s+$", "")
    note = (text == "") | text.startswith("//") | (text.startswith("(*") & text.endswith("*)"))
    bare = F.upper(F.regexp_replace(text, r";+$", "")).isin("ELSE", "END_IF", "END_PROGRAM", "END_CASE", "END_FOR", "END_WHILE", "VAR", "VAR_INPUT", "VAR_OUTPUT", "VAR_IN_OUT", "END_VAR", "IF", "ELSIF", "THEN")
    declared = text.contains(":") & ~text.contains(":=") & text.endswith(";")
    control = line.rlike(r"(?i)^\s*(IF|ELSIF)\b.*\bTHEN\b\s*$") | line.rlike(r"(?i)^\s*ELSE\b\s*$") | line.rlike(r"(?i)^\s*END_IF\b\s*;?\s*$")
    return ~note & ~bare & ~declared & ~control & text.rlike(r"(?i):=|\b(RETURN|EXIT|CONTINUE)\b|\w+\s*\(")


def is_covered_kind(line: Column) -> Column:
    """For coverage: control heads and anything with a bracket or an assignment, case as written; no declarations and no structural keywords."""
    text = F.regexp_replace(clean_line(line), r"^\s+|\s+$", "")
    head = text.rlike(r"^(IF|ELSIF|CASE|FOR|WHILE|REPEAT|UNTIL)\b")
    declared = text.contains(":") & ~text.contains(":=") & text.endswith(";")
    structural = text.rlike(r"^(END_\w+|VAR|VAR_(INPUT|OUTPUT|IN_OUT|GLOBAL|TEMP|EXTERNAL)|PROGRAM|FUNCTION|FUNCTION_BLOCK)\b")
    return (text != "") & ~structural & ~declared & (head | text.contains(":=") | text.contains("("))


def matches_any(name: Column, keywords: list[str]) -> Column:
    """Substring match in any case: ``err`` is in ``Interrupt``."""
    if not keywords:
        return F.lit(False)
    return F.lower(name).rlike("|".join(re.escape(k.lower()) for k in keywords))


def if_condition(header: Column) -> Column:
    """What stands between IF and THEN; TRUE where nothing does."""
    found = F.regexp_replace(F.regexp_extract(header, r"(?is)\bIF\b(.*?)\bTHEN\b", 1), r"^\s+|\s+$", "")
    return F.when(found == "", "TRUE").otherwise(found)


def identifiers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_])[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))


def clipped(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n - 3)), F.lit("..."))).otherwise(text)


def with_period(text: Column) -> Column:
    """An empty text stays empty."""
    return F.when((text == "") | text.rlike(r"[.!?:]$"), text).otherwise(F.concat(text, F.lit(".")))


def normalised_sentence(text: Column) -> Column:
    """One blank after commas, no repeated closing marks, no blanks at the ends."""
    text = F.regexp_replace(F.regexp_replace(text, r",\s*", ", "), r"^\s+|\s+$", "")
    for mark in (r"\.", "!", r"\?"):
        text = F.regexp_replace(text, f"{mark}{{2,}}$", mark.replace("\\", ""))
    return text


def is_number(name: Column) -> Column:
    """Whether Python's float() takes the text: also nan, inf and single underscores between digits."""
    digits = r"\d+(_\d+)*"
    return F.trim(name).rlike(rf"(?i)^[+-]?({digits}\.?({digits})?([eE][+-]?{digits})?|\.{digits}([eE][+-]?{digits})?|nan|inf|infinity)$")


def is_variable(name: Column) -> Column:
    """What counts as a variable in def and use facts."""
    return (F.trim(name) != "") & ~F.upper(F.trim(name)).isin("TRUE", "FALSE") & ~is_number(name)
