"""Plain descriptions of programs at three levels: COARSE (structure), MEDIUM (structure and summaries) and FINE (everything, indented).

Works on statement tables: depths, parents and places within a body are windows over each program, texts are Column expressions.
Arguments are split at commas outside of one level of inner brackets; a header is taken from its own line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depframe.frontend import statements as P
from depframe.functions import text as T
from depframe.operators import sequences as S

LEVELS = ("COARSE", "MEDIUM", "FINE")
KEYS = ["program_id"]
_TRIM = r"^\s+|\s+$"
_BRANCH = ("if", "elsif", "else", "label", "for", "while", "repeat")
_STATEMENT = ("assign", "call", "if", "case", "for", "while", "repeat")


def _expr(text: Column) -> Column:
    return T.clipped(F.regexp_replace(F.regexp_replace(text, _TRIM, ""), r"\s+", " "), 80)


def with_calls(rows: DataFrame) -> DataFrame:
    """``rows`` with ``value`` (the right side of an assignment) and ``call``: callee, call_kind, inputs (name, expr, direction) and outputs.

    ``x := f(...)`` is a function call, a call statement one of a block. Outputs are the target, then arguments after ``=>``, each once.
    """
    value = F.when(F.col("kind") == "assign", F.regexp_replace(F.regexp_replace("raw", rf"^{P._NAME}\s*(:=|\+=|-=|\?=)\s*", ""), r"\s*;$", ""))
    source = F.when(F.col("kind") == "call", F.regexp_replace("raw", r"\s*;$", "")).otherwise(value)
    pattern = rf"^\s*({P._NAME})\s*\((([^()]|\([^()]*\))*)\)\s*$"
    named = source.rlike(pattern) & ~F.upper(F.regexp_extract(source, pattern, 1)).isin(*P.WORDS)
    parts = F.filter(F.split(F.regexp_extract(source, pattern, 2), r",(?![^()]*\))"), lambda a: F.trim(a) != "")

    def argument(a: Column) -> Column:
        name = F.regexp_extract(a, r"^\s*([A-Za-z_]\w*)\s*(:=|=>)", 1)
        out = F.regexp_extract(a, r"^\s*[A-Za-z_]\w*\s*(:=|=>)", 1) == "=>"
        expr = _expr(F.regexp_replace(a, r"^\s*[A-Za-z_]\w*\s*(:=|=>)", ""))
        return F.struct(F.when(name != "", name).alias("name"), expr.alias("expr"), F.when(out, "out").otherwise("in").alias("direction"))

    inputs = F.transform(parts, argument)
    target = F.when(F.col("kind") == "assign", F.array("def")).otherwise(F.array().cast("array<string>"))
    outputs = F.array_distinct(F.concat(target, F.transform(F.filter(inputs, lambda i: i["direction"] == "out"), lambda i: i["expr"])))
    call = F.struct(F.regexp_extract(source, pattern, 1).alias("callee"), F.when(F.col("kind") == "call", "fb").otherwise("function").alias("call_kind"), inputs.alias("inputs"), outputs.alias("outputs"))
    return rows.withColumn("value", value).withColumn("call", F.when(F.col("kind").isin("assign", "call") & named, call))


def nested(rows: DataFrame) -> DataFrame:
    """``rows`` with ``depth`` (of the statement or branch head itself), ``parent`` (line of the branch head whose body holds it) and ``nth`` (its place there, from 1)."""
    kind = F.col("kind")
    marks = rows.withColumns({"__h": kind.isin("if", "case", "for", "while", "repeat").cast("int"), "__e": (kind == "end").cast("int")})
    inner = kind.isin("if", "case", "for", "while", "repeat", "elsif", "else", "label", "until").cast("int")
    marks = S.running_depth(marks, KEYS, ["ln"], "__e", "__h").withColumn("depth", F.greatest(F.col("depth") - inner, F.lit(0)))
    heads = marks.where(kind.isin(*_BRANCH)).select(*KEYS, (F.col("depth") + 1).alias("depth"), "ln", F.col("ln").alias("__head"))
    both = marks.unionByName(heads, allowMissingColumns=True)
    # Of a branch head and what it holds the head comes first; its row at its own depth is no head there.
    before = Window.partitionBy(*KEYS, "depth").orderBy("ln").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("parent", F.last("__head", True).over(before)).where("__head is null")
    place = Window.partitionBy(*KEYS, "parent", "depth").orderBy("ln").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("nth", F.sum(kind.isin(*_STATEMENT).cast("int")).over(place)).drop("__h", "__e", "__head")


def _header(kind: Column) -> Column:
    raw, upper = F.col("raw"), F.upper("raw")
    between = lambda a, b: _expr(F.regexp_replace(F.regexp_replace(raw, rf"(?i)^\s*{a}\b", ""), rf"(?i)\b{b}\s*;?\s*$", ""))
    loop = r"(?is)^\s*FOR\s+.*?:=(.*?)\bTO\b(.*?)(?:\bBY\b(.*?))?\bDO\b"
    part = lambda i: _expr(F.regexp_extract(raw, loop, i))
    step = F.when(part(3) == "", "1").otherwise(part(3))
    text = F.when(kind == "if", F.concat(F.lit("IF "), between("IF", "THEN"), F.lit(" THEN"))).when(kind == "elsif", F.concat(F.lit("ELSIF "), between("ELSIF", "THEN"), F.lit(" THEN")))
    text = text.when(kind == "case", F.concat(F.lit("CASE "), between("CASE", "OF"), F.lit(" OF"))).when(kind == "while", F.concat(F.lit("WHILE "), between("WHILE", "DO"), F.lit(" DO")))
    text = text.when(kind == "for", F.concat(F.lit("FOR "), F.col("def"), F.lit(" = "), part(1), F.lit(" TO "), part(2), F.lit(" BY "), step, F.lit(" DO")))
    text = text.when(kind == "until", F.concat(F.lit("UNTIL "), between("UNTIL", ""))).when(kind == "end", F.regexp_extract(upper, r"^(END_\w+)", 1))
    return text.when(kind == "label", F.concat(F.lit("WHEN "), F.regexp_replace(F.regexp_replace(raw, r"\s*:\s*$", ""), r"\s*,\s*", ", "), F.lit(":"))).otherwise(upper)


def _plain(call: Column) -> Column:
    inputs = F.transform(call["inputs"], lambda i: F.concat(F.coalesce(i["name"], F.lit("<pos>")), F.lit("="), i["expr"], F.lit("("), i["direction"], F.lit(")")))
    outs = F.when(F.size(call["outputs"]) > 0, F.array_join(call["outputs"], ", ")).otherwise("<no_out>")
    what = F.when(call["call_kind"] == "function", "Call function: ").otherwise("Call FB: ")
    text = F.concat(what, outs, F.lit(" <- "), call["callee"], F.lit("("), F.array_join(inputs, ", "), F.lit(")"))
    return F.when(call.isNotNull(), text).otherwise(F.concat(F.lit("Assign "), F.col("def"), F.lit(" = "), _expr(F.col("value"))))


def _meaning(call: Column) -> Column:
    """What the documentation says of a callee (column ``summary``); a shift is spelt out."""
    place = F.filter(call["inputs"], lambda i: i["name"].isNull())
    shift = F.lit("Semantics: Logical left shift")
    full = F.concat(shift, F.lit(": "), F.get(call["outputs"], 0), F.lit(" = "), F.get(place, 0)["expr"], F.lit(" << "), F.get(place, 1)["expr"])
    is_shift = (call["callee"] == "USHLW") & (call["call_kind"] == "function")
    return F.when(is_shift, F.coalesce(full, shift)).when(call.isNotNull(), F.concat(F.lit("Semantics: "), F.col("summary")))


def summaries(rows: DataFrame, items: int = 3) -> DataFrame:
    """(program_id, parent, summary): a body in ``items`` items or so; an IF gives two, itself and what its THEN holds, at the second depth only dots."""
    kind, call = F.col("kind"), F.col("call")
    item = F.when(call.isNotNull(), call["callee"]).when(kind == "assign", F.concat(F.lit("assign "), F.col("def"))).when(kind == "if", "if(...)").when(kind == "case", "case(...)").otherwise(kind)
    children = rows.where(kind.isin(*_STATEMENT) & F.col("parent").isNotNull()).select(*KEYS, "parent", "ln", "kind", item.alias("item"))
    earlier = Window.partitionBy(*KEYS, "parent").orderBy("ln").rowsBetween(Window.unboundedPreceding, -1)
    children = children.withColumn("had", F.coalesce(F.sum(F.when(kind == "if", 2).otherwise(1)).over(earlier), F.lit(0)))

    def joined(inner: Column, of: DataFrame) -> DataFrame:
        texts = F.when(F.col("had") >= items, F.array(F.lit("..."))).when(kind == "if", F.array(F.col("item"), inner)).otherwise(F.array("item"))
        # Of what comes after the items only one row is needed for the dots.
        first = of.where(F.col("had") < items + 2)
        listed = F.array_sort(F.collect_list(F.struct("ln", (F.col("had") >= items).alias("over"), texts.alias("t"))))
        kept = F.concat(F.filter(listed, lambda x: ~x["over"]), F.slice(F.filter(listed, lambda x: x["over"]), 1, 1))
        flat = F.filter(F.flatten(F.transform(kept, lambda x: x["t"])), lambda t: t.isNotNull() & (t != ""))
        return first.groupBy(*KEYS, "parent").agg(F.array_join(flat, "; ").alias("summary"))

    second = joined(F.lit("..."), children).select(*KEYS, F.col("parent").alias("ln"), F.col("summary").alias("inner"))
    return joined(F.col("inner"), children.join(second, [*KEYS, "ln"], "left"))


def described(programs: DataFrame, level: str, docs: DataFrame | None = None, max_depth: int = 7, max_statements: int = 50) -> DataFrame:
    """(program_id, nth, text): the description of every program, framed by ``POU`` and ``END_POU``.

    ``docs`` (callee, summary) adds what a call means. ``max_depth`` and ``max_statements`` fold deep and long bodies of FINE into dots, of
    which, as at the end of any line, one is left.
    A program without statements gives its frame; an empty source nothing.
    """
    if level not in LEVELS:
        raise ValueError(f"level must be one of {LEVELS}")
    lines = P.statement_lines(programs)
    rows = nested(with_calls(P.statements(lines)))
    kind, call = F.col("kind"), F.col("call")
    if docs is not None:
        known = docs.groupBy("callee").agg(F.min("summary").alias("summary")).withColumnRenamed("callee", "__callee")
        rows = rows.join(known, call["callee"] == F.col("__callee"), "left").drop("__callee")
    else:
        rows = rows.withColumn("summary", F.lit(None).cast("string"))
    rows = rows.withColumn("meaning", _meaning(call)).drop("summary")
    name = F.regexp_extract("raw", r"(?i)^\s*(?:PROGRAM|FUNCTION_BLOCK|FUNCTION)\s+(\w+)", 1)
    frame = lines.groupBy(*KEYS).agg(F.coalesce(F.min_by(F.when(name != "", name), F.when(name != "", F.col("ln"))), F.first("program_id").cast("string")).alias("pou"), F.max("ln").alias("last"))

    header = F.when(kind.isin("assign", "call"), _plain(call)).otherwise(_header(kind))
    part = F.when(kind == "if", "THEN actions:").when(kind == "label", F.concat(_header(kind), F.lit(" actions:"))).when(kind.isin("for", "while", "repeat"), "LOOP actions:")
    part = part.otherwise(F.concat(F.upper(kind), F.lit(" actions:")))
    own = F.when(kind.isin("else", "label"), F.array().cast("array<string>")).otherwise(F.array(header))
    body = F.lit(None).cast("string")
    if level == "COARSE":
        rows = rows.where("depth = 0")
    elif level == "MEDIUM":
        rows = rows.where("depth = 0").join(summaries(rows).select(*KEYS, F.col("parent").alias("ln"), F.col("summary")), [*KEYS, "ln"], "left")
        body = F.concat_ws(" ", part, F.when(F.col("summary") != "", F.col("summary")))
    else:
        upto = Window.partitionBy(*KEYS).orderBy("ln").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        over = (F.col("nth") > max_statements) & kind.isin(*_STATEMENT)
        shown = F.lit(True)
        for d in range(1, max_depth):
            held = F.last(F.when((F.col("depth") == d) & kind.isin(*_STATEMENT), over), True).over(upto)
            shown = shown & ~((F.col("depth") >= d) & F.coalesce(held, F.lit(False)))
        sizes = rows.where(kind.isin(*_STATEMENT) & F.col("parent").isNotNull()).groupBy(*KEYS, F.col("parent").alias("ln")).agg(F.count("*").alias("size"))
        rows = rows.withColumn("__shown", shown).join(sizes, [*KEYS, "ln"], "left")
        dots = (F.col("depth") > 0) & kind.isin(*_STATEMENT) & (F.col("nth") == max_statements + 1)
        first_over = F.row_number().over(Window.partitionBy(*KEYS, "parent", "nth").orderBy("ln")) == 1
        rows = rows.withColumn("__dots", dots & first_over).where((F.col("__shown") | F.col("__dots")) & (F.col("depth") < max_depth))
        body = part
    if level == "COARSE":
        texts = F.array(header)
    else:
        texts = F.when(kind.isin(*_BRANCH), F.concat(own, F.array(body))).otherwise(F.array(header))
    texts = F.concat(texts, F.when(F.col("meaning").isNotNull(), F.array("meaning")).otherwise(F.array().cast("array<string>")))
    finished = F.transform(texts, lambda t: T.with_period(T.normalised_sentence(t)))
    if level == "FINE":
        indent = lambda d: F.repeat(F.lit("  "), d.cast("int"))
        deep = F.when(F.col("depth") + 1 >= max_depth, ".").when(F.col("size").isNull(), "<empty>.")
        below = F.when(kind.isin(*_BRANCH) & deep.isNotNull(), F.array(F.concat(indent(F.col("depth") + 1), deep))).otherwise(F.array().cast("array<string>"))
        finished = F.concat(F.transform(finished, lambda t: F.concat(indent(F.col("depth")), t)), below)
        finished = F.when(F.col("__dots") & ~F.col("__shown"), F.array(F.concat(indent(F.col("depth")), F.lit(".")))).otherwise(finished)
    told = rows.select(*KEYS, F.col("ln").cast("long").alias("ln"), F.posexplode(finished).alias("i", "text"))
    edge = lambda ln, word: frame.select(*KEYS, ln.cast("long").alias("ln"), F.lit(0).alias("i"), F.concat(F.lit(f"{word} "), F.col("pou"), F.lit(".")).alias("text"))
    every = told.unionByName(edge(F.lit(0), "POU")).unionByName(edge(F.lit(2**62), "END_POU"))
    return every.select(*KEYS, F.row_number().over(Window.partitionBy(*KEYS).orderBy("ln", "i")).alias("nth"), "text")
