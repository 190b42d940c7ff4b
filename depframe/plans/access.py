"""Queries of accesses to parts of variables, over the names that users' events stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depframe.operators import accesses as A
from depframe.session import table

USER = ["user_id"]


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, node, name, event_type): every event touches a part of one of three variables, by a number or a variable index or none."""
    e = F.col("event_id")
    index = F.when(e % 7 < 3, F.concat(F.lit("["), (e % 4).cast("string"), F.lit("]"))).when(e % 7 == 3, "[i]").when(e % 7 == 4, F.concat(F.lit("[1, "), (e % 3).cast("string"), F.lit("]"))).otherwise("")
    field = F.when(F.col("value") > 10, F.concat(F.lit("."), "event_type")).otherwise("")
    last = F.when(F.col("value") > 30, F.concat(F.lit(".k["), (e % 5).cast("string"), F.lit("]"))).otherwise("")
    return table(spark, sf_dir, "events").select("user_id", e.alias("node"), F.concat(F.lit("v"), (e % 3).cast("string"), index, field, last).alias("name"), "event_type")


def access_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each event's name the base, the fields and the indices."""
    joined = lambda c: F.array_join(c, "/")
    return A.accesses(_names(spark, sf_dir)).select("node", "base", joined("fields").alias("fields"), joined("indices").alias("indices"))


def access_meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What clicks and purchases of a user define against what its other events use."""
    names, defines = _names(spark, sf_dir), F.col("event_type").isin("click", "purchase")
    return A.meeting_accesses(names.where(defines), names.where(~defines), USER)


QUERIES = {f.__name__: f for f in (access_parts, access_meetings)}

_SQL_NAMES = r"""
    n AS (SELECT user_id, event_id AS node, event_type,
              'v' || event_id % 3 || CASE WHEN event_id % 7 < 3 THEN '[' || event_id % 4 || ']' WHEN event_id % 7 = 3 THEN '[i]' WHEN event_id % 7 = 4 THEN '[1, ' || event_id % 3 || ']' ELSE '' END
              || CASE WHEN value > 10 THEN '.' || event_type ELSE '' END || CASE WHEN value > 30 THEN '.k[' || event_id % 5 || ']' ELSE '' END AS name
          FROM events)"""
_SQL_PATH = r"regexp_extract_all(replace(name, ' ', ''), '^[^.\[]+|\[[^\]]*\]|\.[^.\[]+')"
_NUMBER = r"'\[[0-9,]+\]'"

ORACLES = {
    "access_parts": rf"""
    WITH {_SQL_NAMES}, p AS (SELECT node, {_SQL_PATH} AS p FROM n)
    SELECT node, p[1] AS base, coalesce(array_to_string([x[2:] FOR x IN p IF x[1] = '.'], '/'), '') AS fields,
        coalesce(array_to_string([x[2:-2] FOR x IN p IF x[1] = '['], '/'), '') AS indices FROM p""",
    "access_meetings": rf"""
    WITH {_SQL_NAMES}, p AS (SELECT DISTINCT user_id, event_type IN ('click', 'purchase') AS defines, name, {_SQL_PATH} AS p FROM n),
    pairs AS (SELECT d.user_id, d.name AS def_name, u.name AS use_name, d.p AS dp, u.p AS up, range(1, least(len(d.p), len(u.p)) + 1) AS r
              FROM p d JOIN p u ON d.user_id = u.user_id AND d.p[1] = u.p[1] WHERE d.defines AND NOT u.defines),
    told AS (SELECT *, [dp[i] = up[i] FOR i IN r] AS eq,
                 [dp[i] = up[i] OR (dp[i][1] = '[' AND up[i][1] = '[' AND NOT (regexp_full_match(dp[i], {_NUMBER}) AND regexp_full_match(up[i], {_NUMBER}))) FOR i IN r] AS ok FROM pairs)
    SELECT user_id, def_name, use_name, CASE WHEN len(dp) = len(up) THEN 'same' WHEN len(dp) < len(up) THEN 'whole' ELSE 'part' END AS relation, list_bool_and(eq) AS sure
    FROM told WHERE list_bool_and(ok)""",
}
