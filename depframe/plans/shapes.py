"""Queries of operators that shape blocks of code. A user's events in order make a program: each gives some lines of well-formed code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from depframe.frontend import functional as A
from depframe.frontend import statements as P
from depframe.functions import text as T
from depframe.operators import blocks as B
from depframe.operators import policy as Y
from depframe.operators import sequences as S
from depframe.operators import skeletons as K
from depframe.operators import slices as L
from depframe.plans.graphs import _EDGES, _supply_edges
from depframe.session import materialise, table

USER = ["user_id"]
#: Lines of code that an event stands for, in SQL that both engines read; a bar ends a line.
_PARTS = (
    "valve := level > limit;", "IF a > b THEN|  x := x + 1;|ELSE|  // nothing|END_IF;", "IF c THEN||ELSIF d THEN|  run(x);|ELSE|  y := 2;|END_IF;",
    "CASE stage OF|1:|  x := 2;|2:|  CASE mode OF|  7:|    y := x;|  END_CASE;|  z := y;|  IF y > 1 THEN|    z := 4;|  ELSE|    z := 3;|  END_IF;|ELSE|  z := 0;|END_CASE;",
    "FOR i := 1 TO 9 DO|  sum := sum + i;|END_FOR;", "stage := 3;", "WHILE x > 0 DO|  x := x - 1;|  IF x = 4 THEN|    // only a note|  END_IF;|END_WHILE;",
    "IF c THEN|  valve := sum > limit;|ELSIF a THEN|ELSE|END_IF;", "REPEAT|  y := y + 1;|UNTIL y > 9|END_REPEAT;", "timer(IN := start,|  PT := (delay|  + 1));",
    "IF a THEN|  IF b THEN|  ELSE|    errCode := 7;|  END_IF;|ELSE|END_IF;", "CASE mode OF|END_CASE;", "IF stage = 2 THEN|  stage := 3;|  posX := posX + dist(x,|    (y));|END_IF;", "(* note *)|",
)
_PART = "CASE (5 * event_id + 3 * user_id) % 14 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_PARTS)) + " END"
#: The same with brackets that are left open, or closed twice, here and there.
_LOOSE = f"CASE event_id % 17 WHEN 3 THEN 'w := ((a;|u := b;' WHEN 8 THEN 'v := b));' WHEN 11 THEN 'run(a,' ELSE {_PART} END"


def code_lines(spark: SparkSession, sf_dir: str, part: str = _PART) -> DataFrame:
    """(user_id, event_id, ln, raw). Queries that read it more than once write it first, or each reading numbers all lines anew."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.posexplode(F.split(F.expr(part), r"\|", -1)).alias("pos", "raw"))
    return events.select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id", "pos")).cast("long").alias("ln"), "raw")


def statement_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The end of the statement that begins on each line, for all lines."""
    code = code_lines(spark, sf_dir, _LOOSE)
    return K.statement_ends(code, code, USER).select("user_id", "start", "end")


def _hits(code: DataFrame) -> DataFrame:
    return code.where("(event_id + ln) % 5 = 0").select("user_id", "ln")


def case_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.case_branches(code_lines(spark, sf_dir), USER).select("user_id", "head", "body_end", F.col("start").cast("long").alias("start"))


def case_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = materialise(code_lines(spark, sf_dir), "code")
    spans, branches = materialise(B.construct_spans(code, USER, "CASE"), "cases"), materialise(K.case_branches(code, USER), "case-branches")
    return K.patched_cases(_hits(code), spans, branches, USER)


def if_skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks lack every third executable line, so some branches are empty."""
    code = code_lines(spark, sf_dir)
    block = materialise(code.where(~(T.is_executable(F.col("raw")) & F.expr("(event_id + ln) % 3 = 0"))), "block")
    return K.if_skeleton(block, USER).select("user_id", "ln", "raw")


def stage_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.stage_segments(code_lines(spark, sf_dir), USER, 8).select("user_id", "ln", F.col("segment").cast("long").alias("segment"))


def size_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks hold five lines of seven."""
    block = code_lines(spark, sf_dir).where("ln % 7 < 5")
    return K.size_segments(block, USER, 12, 40).select("user_id", "ln", F.col("segment").cast("long").alias("segment"))


def segment_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other line is a statement of the block; IFs also have their end as a line."""
    code = materialise(code_lines(spark, sf_dir), "code")
    ends = B.construct_spans(code, USER, "IF").select("user_id", F.col("start").alias("node"), F.explode(F.array("start", "end")).alias("ln"))
    own = code.select("user_id", F.col("ln").alias("node"), "ln").union(ends).distinct()
    nodes = code.where("(event_id + ln) % 2 = 0").select("user_id", F.col("ln").alias("node"))
    return K.segment_nodes(nodes, own, K.stage_segments(code, USER, 8), USER).select("user_id", F.col("segment").cast("long").alias("segment"), "node")


def meaningful_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's lines are a block of its own; those of three lines and more that act."""
    return K.is_meaningful(code_lines(spark, sf_dir), ["user_id", "event_id"], 3).select("event_id")


def policy_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expensive orders as criteria of four kinds: back over all edges, over data only, over control only; and the regions of their customers' nations."""
    seeds = table(spark, sf_dir, "orders").where("o_totalprice > 350000").selectExpr("'both' AS crit", "concat('o', o_orderkey) AS node", "CAST(NULL AS string) AS slice_strategy", "CAST(NULL AS boolean) AS use_data", "true AS use_control", "o_orderkey % 4 AS k", "o_custkey")
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    nations = seeds.where("k = 3").join(customer, "o_custkey").selectExpr("'region' AS crit", "concat('n', c_nationkey) AS node", "'region' AS slice_strategy", "false AS use_data", "false AS use_control").distinct()
    some = lambda k, crit, data, control: seeds.where(f"k = {k}").selectExpr(f"'{crit}' AS crit", "node", "'backward_multi' AS slice_strategy", f"{data} AS use_data", f"{control} AS use_control")
    every = seeds.where("k = 0").select("crit", "node", "slice_strategy", "use_data", "use_control").union(some(1, "data", "true", "false")).union(some(2, "control", "false", "true")).union(some(2, "none", "false", "false")).union(nations)
    return L.policy_slices(every, _supply_edges(spark, sf_dir), ["crit"])


def edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.edge_counts(_supply_edges(spark, sf_dir), [])


def region_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the regions of customers, by nation."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", "c_custkey")
    return L.region_sizes(orders, ["c_nationkey", "c_custkey"], ["c_nationkey"])


#: Settings by type and an event's own, each of which overrides something of the one before.
_FILE = """CASE event_type WHEN 'click' THEN '{"slice": {"use_data": false, "depth": {"most": 5}}, "post": {"patch_if": true}}' WHEN 'error' THEN '{"slice": "off", "tag": {"a": 1}}'
    WHEN 'view' THEN '{"slice": {"depth": 3}}' END"""
_OWN = """CASE event_id % 4 WHEN 0 THEN '{"slice": {"depth": {"least": 1}}}' WHEN 1 THEN '{"tag": {"b": 2}, "slice": {"use_data": true}}' WHEN 2 THEN '{"post": 7}' END"""
_BASE = """'{"slice": {"use_data": true, "use_control": true, "depth": {"most": 9, "least": 0}}, "post": {"patch_if": false}}'"""


def policy_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open settings of three layers; some leaves of what they make."""
    events = table(spark, sf_dir, "events")
    layers = [events.select("event_id", F.lit(i).alias("layer"), F.expr(text).alias("settings")) for i, text in enumerate((_BASE, _FILE, _OWN))]
    merged = Y.merged_documents(layers[0].union(layers[1]).union(layers[2]), ["event_id"])
    leaf = lambda path, name: F.try_variant_get("settings", path, "string").alias(name)
    return merged.select("event_id", leaf("$.slice.use_data", "use_data"), leaf("$.slice.depth.most", "most"), leaf("$.slice.depth.least", "least"), leaf("$.post.patch_if", "patch_if"), leaf("$.tag.a", "a"), leaf("$.tag.b", "b"))


_HEAD = "PROGRAM p|VAR_INPUT level : REAL; limit : REAL; END_VAR|VAR_OUTPUT valve : BOOL; posX : REAL; errCode : INT; END_VAR|VAR stage : INT; x : INT; y : INT; sum : REAL; END_VAR"


def program_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(program_id, source): each user's events as a program with declarations."""
    code = code_lines(spark, sf_dir).select(F.col("user_id").alias("program_id"), "ln", "raw")
    heads = code.select("program_id").distinct().select("program_id", F.posexplode(F.split(F.lit(_HEAD), r"\|")).alias("ln", "raw")).withColumn("ln", F.col("ln") - 10)
    return S.rendered(code.union(heads.select("program_id", F.col("ln").cast("long"), "raw")), ["program_id"], ["ln"], F.col("raw"), "source")


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(program_id, ln, raw): the same with statements on lines of their own."""
    return P.statement_lines(program_sources(spark, sf_dir))


def distinct_programs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame | None]:
    """The lines of ``programs``, of equal sources the first only, and (program_id, rep) of all programs, None where no two are equal. Two hashes of 64 bits stand for a source."""
    sources = materialise(program_sources(spark, sf_dir), "sources")
    marks = ["mark", "mark2"]
    marked = materialise(sources.select("program_id", F.xxhash64("source").alias("mark"), F.xxhash64(F.lit(1), "source").alias("mark2")), "marks")
    firsts = marked.groupBy(*marks).agg(F.min("program_id").alias("rep"))
    copies = materialise(marked.join(firsts, marks).select("program_id", "rep"), "copies")
    if copies.where("program_id != rep").isEmpty():
        return P.statement_lines(sources), None
    return P.statement_lines(sources.join(copies.where("program_id = rep").select("program_id"), "program_id", "left_semi")), copies


def of_all_copies(found: DataFrame, copies: DataFrame | None) -> DataFrame:
    """What was found in distinct programs, for every program."""
    if copies is None:
        return found
    return found.withColumnRenamed("program_id", "rep").join(copies, "rep").select(*found.columns)


_WORDS = ("IF", "CASE", "FOR", "WHILE", "REPEAT")


def _all_spans(code: DataFrame) -> DataFrame:
    return B.all_spans(code, USER, _WORDS).select("user_id", F.col("start").cast("long"), F.col("end").cast("long"))


def parent_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every line the control statement around it, and the last line of what begins there."""
    code = materialise(code_lines(spark, sf_dir), "code")
    return K.nested_parents(code.select("user_id", "ln"), _all_spans(code), USER, "ln")


def statement_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers within each control statement and all that it holds."""
    code = materialise(code_lines(spark, sf_dir), "code")
    names = code.select("user_id", "ln", F.explode(T.identifiers(F.regexp_replace(F.col("raw"), "//.*", ""))).alias("name"))
    held = _all_spans(code).withColumn("head", F.col("start"))
    found = K.names_within(names, held, ["user_id", "head"], "start", "end")
    return found.groupBy("user_id", "head").agg(F.count("*").alias("n_names"), F.min("name").alias("least"))


def functional_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of all functional blocks of all programs. A program's blocks hang on its source alone, so equal programs are taken once."""
    lines, copies = distinct_programs(spark, sf_dir)
    return of_all_copies(A.functional_blocks(materialise(lines, "programs"))[0].select("program_id", "block", "ln", F.col("raw").alias("text")), copies)


def completed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, copies = distinct_programs(spark, sf_dir)
    lines = materialise(lines, "programs")
    block, nodes, rows = A.functional_blocks(lines)
    done = A.completed_blocks(block, nodes, rows, P.symbols(lines))
    return of_all_copies(done.select("program_id", "block", "code", F.size("line_numbers").cast("long").alias("n_lines"), F.array_join("vars_used", ",").alias("vars_used")), copies)


QUERIES = {
    f.__name__: f
    for f in (policy_documents, parent_map, statement_names, functional_blocks, completed_blocks, statement_ends, case_branches, case_patch, if_skeleton, stage_segments, size_segments, segment_nodes, meaningful_code, policy_slices, edge_counts, region_sizes)
}

_LINES = """c AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id, pos) AS ln, raw FROM (
    SELECT user_id, event_id, unnest(string_split({part}, '|')) AS raw, generate_subscripts(string_split({part}, '|'), 1) AS pos FROM events))"""
_CODE = _LINES.format(part=_PART)


def _spans(head: str, end: str) -> str:
    return f"""SELECT h.user_id, h.ln AS start_ln, min(e.ln) AS end_ln FROM d h JOIN d e ON e.user_id = h.user_id AND e.ln > h.ln AND e.{end} AND e.{head}s - e.{end}s = h.{head}s - 1 - h.{end}s
        WHERE h.{head} GROUP BY h.user_id, h.ln"""


#: A head's count is up to its own line; an end that takes the level back to the one before the head ends it.
_DEPTHS = f"""f AS (SELECT *, trim(raw) AS t, starts_with(trim(raw), 'IF ') AS i, starts_with(trim(raw), 'END_IF') AS ie, starts_with(trim(raw), 'CASE ') AS k, starts_with(trim(raw), 'END_CASE') AS ke FROM {{t}}),
    d AS (SELECT *, {", ".join(f"(count(*) FILTER ({x}) OVER (PARTITION BY user_id ORDER BY ln))::BIGINT AS {x}s" for x in ("i", "ie", "k", "ke"))} FROM f),
    ifs AS ({_spans("i", "ie")}), ks AS ({_spans("k", "ke")})"""
_CASES = f"""{_CODE}, {_DEPTHS.format(t="c")},
    mixed AS (SELECT *, true AS is_case FROM ks UNION ALL SELECT *, false FROM ifs),
    lab AS (SELECT f.user_id, f.ln, max(start_ln) AS start_ln FROM f JOIN ks ON ks.user_id = f.user_id AND start_ln < f.ln AND f.ln < end_ln WHERE regexp_matches(t, ':([^=]|$)') AND NOT contains(t, ':=') GROUP BY ALL),
    els AS (SELECT f.user_id, f.ln, max(start_ln) AS start_ln, max_by(is_case, start_ln) AS is_case FROM f JOIN mixed b ON b.user_id = f.user_id AND start_ln < f.ln AND f.ln < end_ln WHERE t = 'ELSE' GROUP BY ALL),
    own AS (SELECT user_id, ln, start_ln FROM lab UNION ALL SELECT user_id, ln, start_ln FROM els WHERE is_case),
    br AS (SELECT o.user_id, o.ln AS head, o.start_ln, coalesce(lead(o.ln) OVER (PARTITION BY o.user_id, o.start_ln ORDER BY o.ln), end_ln) - 1 AS body_end FROM own o JOIN ks ON ks.user_id = o.user_id AND ks.start_ln = o.start_ln)"""
_MARKER = r"(regexp_matches(raw, '(?i)\bIF\b.*\b(stage|state)\b\s*=\s*[\w.#]+') OR regexp_matches(raw, '(?i)^\s*CASE\b.*\b(stage|state)\b.*\bOF\b') OR regexp_matches(raw, '(?i)\b(stage|state)\b\s*:=\s*[\w.#]+'))"
_MERGED = """n AS (SELECT user_id, seg, count(*) AS n FROM g GROUP BY ALL), o AS (SELECT *, sum(CASE WHEN first OR n >= {least} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY seg)::BIGINT AS segment
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seg) = 1 AS first FROM n)),
    z AS (SELECT *, sum(n) OVER (PARTITION BY user_id, segment) AS total FROM o),
    y AS (SELECT *, max(total) OVER (PARTITION BY user_id) AS most FROM z), m AS (SELECT user_id, seg, CASE WHEN most < {half} THEN 1 ELSE segment END AS segment FROM y WHERE total >= {half} OR most < {half})"""
_STAGES = f"""{_CODE}, g AS (SELECT *, sum(CASE WHEN {_MARKER} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ln) AS seg FROM c), {_MERGED.format(least=8, half=4)}"""
_ACTS = r"""(t <> '' AND NOT starts_with(t, '//') AND NOT (starts_with(t, '(*') AND ends_with(t, '*)')) AND upper(rtrim(t, ';')) NOT IN ('ELSE', 'END_IF', 'END_CASE', 'END_FOR', 'END_WHILE')
    AND NOT (contains(t, ':') AND NOT contains(t, ':=') AND ends_with(t, ';')) AND NOT regexp_matches(t, '^(IF|ELSIF)\b.*\bTHEN$') AND regexp_matches(t, ':=|\w+\s*\('))"""

def _all(words: tuple[str, ...]) -> str:
    flags = ", ".join(f"starts_with(trim(raw), '{w}') AS h{i}, starts_with(trim(raw), 'END_{w}') AS e{i}" for i, w in enumerate(words))
    sums = ", ".join(f"(count(*) FILTER ({x}{i}) OVER (PARTITION BY user_id ORDER BY ln))::BIGINT AS {x}{i}s" for i in range(len(words)) for x in "he")
    return f"f AS (SELECT user_id, ln, raw, {flags} FROM c), d AS (SELECT *, {sums} FROM f), sp AS (" + " UNION ALL ".join(_spans(f"h{i}", f"e{i}") for i in range(len(words))) + ")"


_LEAVES = ", ".join(f"json_extract_string(m, '$.{p}') AS {n}" for p, n in (("slice.use_data", "use_data"), ("slice.depth.most", "most"), ("slice.depth.least", "least"), ("post.patch_if", "patch_if"), ("tag.a", "a"), ("tag.b", "b")))

ORACLES = {
    "policy_documents": f"""SELECT event_id, {_LEAVES} FROM (SELECT event_id, json_merge_patch(json_merge_patch({_BASE}::JSON, coalesce({_FILE}, '{{}}')::JSON), coalesce({_OWN}, '{{}}')::JSON) AS m FROM events)""",
    "parent_map": f"""WITH {_CODE}, {_all(_WORDS)} SELECT c.user_id, c.ln, max(p.start_ln) AS parent, coalesce(max(o.end_ln), c.ln) AS upto FROM c LEFT JOIN sp p ON p.user_id = c.user_id AND p.start_ln < c.ln AND c.ln < p.end_ln
        LEFT JOIN sp o ON o.user_id = c.user_id AND o.start_ln = c.ln GROUP BY c.user_id, c.ln""",
    "statement_names": f"""WITH {_CODE}, {_all(_WORDS)}, n AS (SELECT user_id, ln, unnest(regexp_extract_all(regexp_replace(raw, '//.*', ''), '[A-Za-z0-9_]+')) AS name FROM c)
        SELECT sp.user_id, start_ln AS head, count(DISTINCT name) AS n_names, min(name) AS least FROM sp JOIN n ON n.user_id = sp.user_id AND n.ln BETWEEN start_ln AND end_ln WHERE regexp_matches(name, '^[A-Za-z_]') GROUP BY ALL""",
    "statement_ends": f"""WITH {_LINES.format(part=_LOOSE)}, x AS (SELECT user_id, ln, regexp_replace(regexp_replace(raw, '//.*', ''), '\\(\\*.*?\\*\\)', '', 'g') AS t FROM c),
        b AS (SELECT user_id, ln, contains(t, ';') AS semi, length(t) - length(replace(t, '(', '')) - length(t) + length(replace(t, ')', '')) AS delta FROM x),
        r AS (SELECT *, sum(delta) OVER (PARTITION BY user_id ORDER BY ln)::BIGINT AS after FROM b)
        SELECT s.user_id, s.ln AS start, coalesce(min(e.ln), s.ln) AS end FROM r s LEFT JOIN r e ON e.user_id = s.user_id AND e.ln >= s.ln AND e.semi AND e.after <= s.after - s.delta GROUP BY s.user_id, s.ln""",
    "case_branches": f"WITH {_CASES} SELECT user_id, head, body_end, start_ln AS start FROM br",
    "case_patch": f"""WITH {_CASES}, h AS (SELECT user_id, ln FROM c WHERE (event_id + ln) % 5 = 0),
        act AS (SELECT * FROM ks WHERE EXISTS (SELECT 1 FROM h WHERE h.user_id = ks.user_id AND h.ln > start_ln AND h.ln < end_ln) AND (
            EXISTS (SELECT 1 FROM h WHERE h.user_id = ks.user_id AND h.ln IN (start_ln, end_ln)) OR EXISTS (SELECT 1 FROM h JOIN br ON br.user_id = h.user_id AND br.head = h.ln WHERE br.user_id = ks.user_id AND br.start_ln = ks.start_ln))),
        good AS (SELECT * FROM act WHERE EXISTS (SELECT 1 FROM br WHERE br.user_id = act.user_id AND br.start_ln = act.start_ln)),
        bare AS (SELECT * FROM act WHERE NOT EXISTS (SELECT 1 FROM br WHERE br.user_id = act.user_id AND br.start_ln = act.start_ln)),
        hit AS (SELECT br.user_id, br.head FROM br JOIN good g ON g.user_id = br.user_id AND g.start_ln = br.start_ln WHERE EXISTS (SELECT 1 FROM h WHERE h.user_id = br.user_id AND h.ln > br.head AND h.ln <= br.body_end))
        SELECT user_id, ln FROM h WHERE NOT EXISTS (SELECT 1 FROM bare b WHERE b.user_id = h.user_id AND h.ln IN (start_ln, end_ln))
        UNION SELECT user_id, start_ln FROM good UNION SELECT user_id, end_ln FROM good UNION SELECT user_id, head FROM hit""",
    "if_skeleton": f"""WITH {_CODE}, blk AS (SELECT * FROM (SELECT *, trim(raw) AS t FROM c) WHERE NOT ({_ACTS} AND (event_id + ln) % 3 = 0)), {_DEPTHS.format(t="(SELECT user_id, event_id, ln, raw FROM blk) q")},
        mid AS (SELECT f.user_id, f.ln AS head, max(start_ln) AS start_ln FROM f JOIN ifs ON ifs.user_id = f.user_id AND start_ln < f.ln AND f.ln < end_ln WHERE t = 'ELSE' OR starts_with(t, 'ELSIF ') GROUP BY ALL),
        elsewhere AS (SELECT m.user_id, m.head FROM mid m JOIN ks ON ks.user_id = m.user_id AND ks.start_ln > m.start_ln AND ks.start_ln < m.head AND ks.end_ln > m.head),
        heads AS (SELECT user_id, start_ln AS head, start_ln FROM ifs UNION ALL SELECT user_id, head, start_ln FROM mid),
        br AS (SELECT h.user_id, head, h.start_ln, end_ln, coalesce(lead(head) OVER (PARTITION BY h.user_id, h.start_ln ORDER BY head), end_ln) - 1 AS body_end FROM heads h JOIN ifs ON ifs.user_id = h.user_id AND ifs.start_ln = h.start_ln),
        ac AS (SELECT br.*, EXISTS (SELECT 1 FROM f WHERE f.user_id = br.user_id AND f.ln > head AND f.ln <= body_end AND {_ACTS}) AS acts FROM br),
        fi AS (SELECT ac.*, f.t AS head_t, f.raw AS head_raw, min(CASE WHEN acts THEN head END) OVER (PARTITION BY ac.user_id, start_ln) AS first FROM ac JOIN f ON f.user_id = ac.user_id AND f.ln = head),
        al AS (SELECT *, max(CASE WHEN head = first THEN (head_t = 'ELSE')::INT END) OVER (PARTITION BY user_id, start_ln) = 1 AS alone FROM fi),
        gone AS (SELECT user_id, head AS low, body_end AS high FROM al WHERE first IS NOT NULL AND (NOT acts OR (alone AND head <> first)) UNION ALL SELECT user_id, start_ln, end_ln FROM al WHERE first IS NULL),
        ind AS (SELECT user_id, ln AS start_ln, regexp_extract(raw, '^ *') AS indent FROM f),
        new AS (SELECT al.user_id, head AS ln, CASE WHEN alone THEN indent || 'IF TRUE THEN' ELSE regexp_replace(head_raw, 'ELSIF ', 'IF ') END AS raw FROM al JOIN ind USING (user_id, start_ln) WHERE head = first
                UNION ALL SELECT al.user_id, end_ln, indent || 'END_IF;' FROM al JOIN ind USING (user_id, start_ln) WHERE head = first AND alone)
        SELECT user_id, ln, coalesce(new.raw, f.raw) AS raw FROM f LEFT JOIN new USING (user_id, ln) WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.user_id = f.user_id AND f.ln BETWEEN low AND high)""",
    "stage_segments": f"WITH {_STAGES} SELECT user_id, ln, segment FROM g JOIN m USING (user_id, seg)",
    "size_segments": f"""WITH RECURSIVE {_CODE}, bl AS (SELECT user_id, ln, raw, row_number() OVER (PARTITION BY user_id ORDER BY ln) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM c WHERE ln % 7 < 5),
        w AS (SELECT user_id, ln, rn, n, (regexp_matches(raw, '^\\s*(IF|FOR|CASE|WHILE|REPEAT)\\b'))::INT AS h, (regexp_matches(raw, '\\bEND_(IF|CASE|FOR|WHILE|REPEAT)\\b'))::INT AS e FROM bl),
        st AS (SELECT user_id, rn, ln, n, greatest(h - e, 0) AS depth, CASE WHEN n > 40 AND 1 >= 40 AND greatest(h - e, 0) = 0 THEN 0 ELSE 1 END AS have, 0 AS seg FROM w WHERE rn = 1
               UNION ALL SELECT w.user_id, w.rn, w.ln, w.n, greatest(st.depth - w.e + w.h, 0),
                 CASE WHEN (CASE WHEN st.have = 0 OR (st.have >= 12 AND st.depth = 0 AND w.ln <> st.ln + 1) THEN 1 ELSE st.have + 1 END) >= 40 AND greatest(st.depth - w.e + w.h, 0) = 0 THEN 0
                      WHEN st.have = 0 OR (st.have >= 12 AND st.depth = 0 AND w.ln <> st.ln + 1) THEN 1 ELSE st.have + 1 END,
                 st.seg + CASE WHEN w.n > 40 AND (st.have = 0 OR (st.have >= 12 AND st.depth = 0 AND w.ln <> st.ln + 1)) THEN 1 ELSE 0 END
               FROM st JOIN w ON w.user_id = st.user_id AND w.rn = st.rn + 1),
        g AS (SELECT user_id, ln, seg FROM st WHERE n > 40), {_MERGED.format(least=12, half=6)}
        SELECT user_id, ln, segment FROM g JOIN m USING (user_id, seg) UNION ALL SELECT user_id, ln, 1 FROM bl WHERE n <= 40""",
    "segment_nodes": f"""WITH {_STAGES}, {_DEPTHS.format(t="c")}, own AS (SELECT user_id, ln AS node, ln FROM c UNION SELECT user_id, start_ln, end_ln FROM ifs)
        SELECT DISTINCT own.user_id, m.segment, own.node FROM own JOIN c ON c.user_id = own.user_id AND c.ln = own.node AND (c.event_id + c.ln) % 2 = 0
        JOIN g ON g.user_id = own.user_id AND g.ln = own.ln JOIN m ON m.user_id = g.user_id AND m.seg = g.seg""",
    "meaningful_code": f"""WITH {_CODE}, x AS (SELECT event_id, trim(raw) AS t FROM c)
        SELECT event_id FROM x GROUP BY event_id HAVING count(*) >= 3 AND bool_or(NOT starts_with(t, '//') AND NOT (starts_with(t, '(*') AND ends_with(t, '*)')) AND (contains(t, ':=') OR (contains(t, '(') AND contains(t, ')')
            AND NOT regexp_matches(t, '^(IF|THEN|ELSE|ELSIF|END_IF|CASE|OF|END_CASE|FOR|TO|DO|END_FOR|WHILE|END_WHILE|REPEAT|UNTIL|END_REPEAT)'))))""",
    "policy_slices": f"""WITH RECURSIVE {_EDGES}, o AS (SELECT 'o' || o_orderkey AS node, o_orderkey % 4 AS k, o_custkey FROM orders WHERE o_totalprice > 350000),
        b AS (SELECT 'both' AS crit, node FROM o WHERE k = 0 UNION SELECT b.crit, g.src FROM b JOIN g ON g.dst = b.node),
        d AS (SELECT 'data' AS crit, node FROM o WHERE k = 1 UNION SELECT d.crit, g.src FROM d JOIN g ON g.dst = d.node AND g.etype = 'data'),
        t AS (SELECT 'control' AS crit, node FROM o WHERE k = 2 UNION SELECT t.crit, g.src FROM t JOIN g ON g.dst = t.node AND g.etype = 'control'),
        r AS (SELECT DISTINCT 'region' AS crit, 'n' || c_nationkey AS node FROM o JOIN customer ON c_custkey = o_custkey WHERE k = 3 UNION SELECT r.crit, g.dst FROM r JOIN g ON g.src = r.node AND g.etype = 'control')
        SELECT * FROM b UNION ALL SELECT * FROM d UNION ALL SELECT * FROM t UNION ALL SELECT * FROM r UNION ALL SELECT 'none', node FROM o WHERE k = 2""",
    "edge_counts": f"WITH {_EDGES} SELECT etype, count(*) AS n FROM (SELECT DISTINCT src, dst, etype FROM g) GROUP BY etype",
    "region_sizes": """WITH s AS (SELECT c_nationkey, c_custkey, count(*) AS size FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY size) - 1 AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM s)
        SELECT c_nationkey, max(n) AS n, min(size) AS least, max(size) FILTER (i = n // 2) AS middle, max(size) AS most FROM r GROUP BY c_nationkey""",
}
