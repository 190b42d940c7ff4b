"""Queries of block and criteria operators. A user's events in order serve as the lines of a program, their numbers choose the text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depframe.operators import blocks as B
from depframe.operators import criteria as C
from depframe.session import table

#: The text of a line in SQL that both engines read.
_RAW = """CASE (event_id * event_id + 31 * user_id) % 16 WHEN 0 THEN 'IF a > b THEN' WHEN 1 THEN 'END_IF;' WHEN 2 THEN 'ELSE' WHEN 3 THEN '  ELSIF c THEN'
    WHEN 4 THEN '' WHEN 5 THEN 'x := 1;' WHEN 6 THEN 'FOR i := 1 TO 9 DO' WHEN 7 THEN 'END_FOR;' WHEN 8 THEN 'IF TRUE THEN' WHEN 9 THEN '  '
    WHEN 10 THEN 'END_IF' WHEN 11 THEN 'run(x);' WHEN 12 THEN '// note' WHEN 13 THEN 'WHILE x < 3 DO' WHEN 14 THEN 'END_WHILE;' ELSE 'IF x = 2 THEN' END"""
_CODE = f"SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS ln, event_id, {_RAW} AS raw FROM events"
#: Definitions and uses of a program's nodes.
_DEF = """CASE event_id % 9 WHEN 0 THEN 'stage' WHEN 1 THEN 'errCode' WHEN 2 THEN 'posX' WHEN 3 THEN 'valve' WHEN 4 THEN 'doneFlag' WHEN 5 THEN 'stepOut' ELSE 'tmp' END"""
_DEF2 = """CASE event_id % 4 WHEN 0 THEN 'phase' WHEN 1 THEN 'valve' WHEN 2 THEN 'fault' END"""
_USE = """CASE event_id % 7 WHEN 0 THEN 'stage' WHEN 1 THEN 'limitX' WHEN 2 THEN 'stopNow' WHEN 3 THEN 'phase' ELSE 'tmp' END"""
_SYMBOLS = "SELECT * FROM (VALUES ('stage', 'VAR'), ('phase', 'VAR'), ('stepOut', 'VAR_OUTPUT'), ('valve', 'VAR_OUTPUT'), ('errCode', 'VAR_IN_OUT'), ('fault', 'VAR'), ('doneFlag', 'VAR'), ('posX', 'VAR')) AS s(name, storage)"
USER = ["user_id"]


def _code(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return spark.sql(_CODE.replace("FROM events", "FROM {events}"), events=events)


def orphan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.without_orphans(_code(spark, sf_dir), USER).select("event_id", "ln")


def if_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.if_balance(_code(spark, sf_dir), USER)


def true_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.without_true_wrappers(_code(spark, sf_dir), USER).select("event_id")


def single_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.with_single_blanks(_code(spark, sf_dir), USER).select("event_id")


def construct_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = _code(spark, sf_dir)
    found = [B.construct_spans(code, USER, word).select("user_id", F.lit(word).alias("word"), F.col("start").alias("start_ln"), F.col("end").alias("end_ln")) for word in ("IF", "FOR", "WHILE")]
    return found[0].union(found[1]).union(found[2])


def if_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.if_branches(_code(spark, sf_dir), USER).select("user_id", "head", "is_else", "body_start", "body_end")


def if_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth event is a line of the slice."""
    code = _code(spark, sf_dir)
    hits = code.where("event_id % 5 = 0").select("user_id", "ln")
    return B.patched_ifs(hits, B.if_branches(code, USER), USER)


def loop_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = _code(spark, sf_dir)
    return B.patched_loops(code.where("event_id % 5 = 0").select("user_id", "ln"), code, USER)


def empty_shells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks hold two lines of three."""
    code = _code(spark, sf_dir)
    block = code.where("event_id % 3 > 0")
    return B.without_empty_shells(block, B.construct_spans(code, USER, "IF"), USER).select("event_id")


def rule_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    defs = events.select("user_id", F.col("event_id").alias("node"), F.explode(F.array(F.expr(_DEF), F.expr(_DEF2))).alias("name")).where("name is not null")
    uses = events.select("user_id", F.col("event_id").alias("node"), F.expr(_USE).alias("name"))
    symbols = events.select("user_id").distinct().join(F.broadcast(spark.sql(_SYMBOLS)))
    return C.rule_criteria(symbols, defs, uses, USER)


def structural_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = _code(spark, sf_dir)
    return C.structural_seeds(code, code.where("event_id % 4 > 0").select("user_id", F.col("event_id").alias("node"), "ln"), USER)


QUERIES = {f.__name__: f for f in (orphan_lines, if_balance, true_wrappers, single_blanks, construct_spans, if_branches, if_patch, loop_patch, empty_shells, rule_criteria, structural_seeds)}

_IF, _END, _MID = r"regexp_matches(raw, '^\s*IF\b.*THEN$')", r"regexp_matches(raw, '^\s*END_IF;?$')", r"regexp_matches(raw, '^\s*(ELSE|ELSIF c THEN)$')"
#: One line after another, as an open-IF counter sees them.
_WALK = f"""c AS ({_CODE}), m AS (SELECT *, {_IF} AS h, {_END} AS e, {_MID} AS m FROM c),
    w AS (SELECT user_id, ln, event_id, raw, h, e, m, CASE WHEN h THEN 1 ELSE 0 END AS depth, NOT (e OR m) AS kept FROM m WHERE ln = 1
          UNION ALL SELECT m.user_id, m.ln, m.event_id, m.raw, m.h, m.e, m.m, CASE WHEN m.h THEN depth + 1 WHEN m.e AND depth > 0 THEN depth - 1 ELSE depth END,
                           NOT ((m.e OR m.m) AND depth = 0) FROM w JOIN m ON m.user_id = w.user_id AND m.ln = w.ln + 1)"""


def _spans(word: str, head: str, end: str) -> str:
    """Heads matched from the inside out: an end takes the last head before it with as many heads as ends between."""
    return f"""SELECT h.user_id, '{word}' AS word, h.ln AS start_ln, min(e.ln) AS end_ln FROM d h JOIN d e ON e.user_id = h.user_id AND e.ln > h.ln AND e.{end} AND e.{head}s - e.{end}s = h.{head}s - 1 - h.{end}s
        WHERE h.{head} GROUP BY h.user_id, h.ln"""


_DEPTHS = f"""c AS ({_CODE}), f AS (SELECT *, starts_with(raw, 'IF ') AS i, starts_with(raw, 'END_IF') AS ie, starts_with(raw, 'FOR ') AS f, raw = 'END_FOR;' AS fe, starts_with(raw, 'WHILE ') AS w, raw = 'END_WHILE;' AS we FROM c),
    d AS (SELECT *, {", ".join(f"(count(*) FILTER ({x}) OVER (PARTITION BY user_id ORDER BY ln))::BIGINT AS {x}s" for x in ("i", "ie", "f", "fe", "w", "we"))} FROM f),
    s AS ({_spans("IF", "i", "ie")} UNION ALL {_spans("FOR", "f", "fe")} UNION ALL {_spans("WHILE", "w", "we")})"""
#: Branch heads of IFs: a middle line belongs to the last IF that starts before it and ends after it.
_BRANCHES = rf"""{_DEPTHS}, ifs AS (SELECT * FROM s WHERE word = 'IF'),
    mid AS (SELECT c.user_id, c.ln AS head, c.raw = 'ELSE' AS is_else, max(start_ln) AS start_ln FROM c JOIN ifs ON ifs.user_id = c.user_id AND start_ln < c.ln AND c.ln < end_ln
            WHERE c.raw = 'ELSE' OR trim(c.raw) = 'ELSIF c THEN' GROUP BY ALL),
    heads AS (SELECT user_id, start_ln AS head, false AS is_else, start_ln FROM ifs UNION ALL SELECT user_id, head, is_else, start_ln FROM mid),
    br AS (SELECT h.user_id, head, is_else, head + 1 AS body_start, coalesce(lead(head) OVER (PARTITION BY h.user_id, h.start_ln ORDER BY head), end_ln) - 1 AS body_end, end_ln
           FROM heads h JOIN ifs ON ifs.user_id = h.user_id AND ifs.start_ln = h.start_ln)"""
_HAS = lambda name, words: "(" + " OR ".join(f"contains(lower({name}), '{w}')" for w in words) + ")"
_K = C.KEYWORDS
_INNER = """SELECT h.user_id, max_by(start_ln, start_ln) AS start_ln, max_by(end_ln, start_ln) AS end_ln FROM {hits} h JOIN s ON s.user_id = h.user_id AND word = '{word}' AND start_ln < h.ln AND h.ln < end_ln
    WHERE NOT EXISTS (SELECT 1 FROM s x WHERE x.user_id = h.user_id AND x.word = '{word}' AND (x.start_ln = h.ln OR x.end_ln = h.ln)) GROUP BY h.user_id, h.ln"""
_ENDS = "SELECT user_id, start_ln AS ln FROM {t} UNION SELECT user_id, end_ln FROM {t}"

ORACLES = {
    "orphan_lines": f"WITH RECURSIVE {_WALK} SELECT event_id, ln FROM w WHERE kept",
    "if_balance": f"""WITH c AS ({_CODE}), r AS (SELECT user_id, ln, sum(CASE WHEN {_IF} THEN 1 WHEN {_END} THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ln)::BIGINT AS s FROM c)
        SELECT user_id, least(min(s), 0)::BIGINT AS least, max_by(s, ln) AS left_open, min(s) >= 0 AND max_by(s, ln) = 0 AS balanced FROM r GROUP BY user_id""",
    "true_wrappers": f"""WITH RECURSIVE {_WALK},
        k AS (SELECT user_id, event_id, raw, h, e, m, row_number() OVER (PARTITION BY user_id ORDER BY ln) AS ln FROM w WHERE kept),
        t AS (SELECT user_id, ln, event_id, raw = 'IF TRUE THEN' AS gone, m, CASE WHEN h THEN [raw = 'IF TRUE THEN'] ELSE [] :: BOOLEAN[] END AS open FROM k WHERE ln = 1
              UNION ALL SELECT k.user_id, k.ln, k.event_id, k.raw = 'IF TRUE THEN' OR (k.e AND open[-1]), k.m,
                               CASE WHEN k.h THEN list_append(open, k.raw = 'IF TRUE THEN') WHEN k.e THEN open[:-2] ELSE open END FROM t JOIN k ON k.user_id = t.user_id AND k.ln = t.ln + 1)
        SELECT event_id FROM t WHERE NOT gone AND NOT (m AND NOT list_contains(open, false))""",
    "single_blanks": rf"""WITH c AS ({_CODE}), b AS (SELECT event_id, trim(raw) = '' AS blank, coalesce(lag(trim(raw) = '') OVER (PARTITION BY user_id ORDER BY ln), false) AS before FROM c)
        SELECT event_id FROM b WHERE NOT (blank AND before)""",
    "construct_spans": f"WITH {_DEPTHS} SELECT user_id, word, start_ln, end_ln FROM s",
    "if_branches": f"WITH {_BRANCHES} SELECT user_id, head, is_else, body_start, body_end FROM br",
    "if_patch": f"""WITH {_BRANCHES}, hits AS (SELECT user_id, ln FROM c WHERE event_id % 5 = 0),
        touched AS (SELECT user_id, head, end_ln FROM br WHERE EXISTS (SELECT 1 FROM hits WHERE hits.user_id = br.user_id AND ln BETWEEN body_start AND body_end))
        SELECT user_id, ln FROM hits UNION SELECT user_id, head FROM touched UNION SELECT user_id, end_ln FROM touched""",
    "loop_patch": f"""WITH {_DEPTHS}, h0 AS (SELECT user_id, ln FROM c WHERE event_id % 5 = 0), f1 AS ({_INNER.format(hits="h0", word="FOR")}), h1 AS (SELECT * FROM h0 UNION {_ENDS.format(t="f1")}),
        f2 AS ({_INNER.format(hits="h1", word="WHILE")}) SELECT user_id, ln FROM h1 UNION {_ENDS.format(t="f2")}""",
    "empty_shells": rf"""WITH {_DEPTHS}, b AS (SELECT * FROM c WHERE event_id % 3 > 0),
        gone AS (SELECT s.* FROM s JOIN b ON b.user_id = s.user_id AND b.ln = start_ln WHERE word = 'IF' AND NOT EXISTS (
                 SELECT 1 FROM b x WHERE x.user_id = s.user_id AND x.ln > start_ln AND x.ln < end_ln AND trim(x.raw) <> '' AND NOT starts_with(x.raw, '//')))
        SELECT event_id FROM b WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.user_id = b.user_id AND (g.start_ln = b.ln OR g.end_ln = b.ln))""",
    "rule_criteria": f"""WITH sy AS ({_SYMBOLS}), df AS (SELECT DISTINCT user_id, node, name FROM (SELECT user_id, event_id AS node, {_DEF} AS name FROM events UNION ALL SELECT user_id, event_id, {_DEF2} FROM events) WHERE name IS NOT NULL),
        us AS (SELECT user_id, event_id AS node, {_USE} AS name FROM events),
        st AS (SELECT user_id, name, (SELECT count(DISTINCT node) FROM df WHERE df.user_id = u.user_id AND df.name = sy.name) >= 2 AND (SELECT count(DISTINCT node) FROM us WHERE us.user_id = u.user_id AND us.name = sy.name) >= 2 AS strong
               FROM (SELECT DISTINCT user_id FROM events) u, sy WHERE {_HAS("name", _K["state"])}),
        sv AS (SELECT user_id, name FROM st x WHERE strong OR NOT EXISTS (SELECT 1 FROM st y WHERE y.user_id = x.user_id AND y.strong)),
        ds AS (SELECT df.user_id, node, min(df.name) AS variable FROM df JOIN sv ON sv.user_id = df.user_id AND sv.name = df.name GROUP BY ALL),
        io AS (SELECT df.* FROM df JOIN sy USING (name) WHERE storage IN ('VAR_OUTPUT', 'VAR_IN_OUT')), er AS (SELECT df.* FROM df JOIN sy USING (name) WHERE {_HAS("name", _K["error"])}),
        dn AS (SELECT df.* FROM df JOIN sy USING (name) WHERE {_HAS("name", _K["done"])}),
        ev AS (SELECT user_id, node, CASE WHEN node IN (SELECT node FROM us WHERE {_HAS("name", _K["interrupt"])}) THEN 'runtime_interrupt' WHEN node IN (SELECT node FROM er) THEN 'runtime_error'
                      WHEN node IN (SELECT node FROM dn) THEN 'runtime_done' END AS kind, variable FROM ds)
        SELECT user_id, node, 'io_output' AS kind, name AS variable FROM io UNION ALL SELECT user_id, node, 'error_logic', name FROM er
        UNION ALL SELECT user_id, node, 'state_transition', variable FROM ds UNION ALL SELECT user_id, node, 'stage_boundary', variable FROM ds WHERE node IN (SELECT node FROM io)
        UNION ALL SELECT user_id, node, kind, variable FROM ev WHERE kind IS NOT NULL
        UNION ALL SELECT user_id, node, 'motion_special_case', min(name) FROM df WHERE {_HAS("name", _K["motion"])} AND node IN (SELECT node FROM us WHERE {_HAS("name", _K["limit"])}) GROUP BY user_id, node""",
    "structural_seeds": f"""WITH c AS ({_CODE}) SELECT user_id, event_id AS node, CASE WHEN starts_with(raw, 'IF ') THEN 'control_region' ELSE 'loop_region' END AS kind, '<line:' || ln || '>' AS variable
        FROM c WHERE event_id % 4 > 0 AND (starts_with(raw, 'IF ') OR starts_with(raw, 'FOR ') OR starts_with(raw, 'WHILE '))""",
}
