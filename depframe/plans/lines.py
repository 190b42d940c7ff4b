"""Queries of line and text functions over documents, pages and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depframe.functions import text as T
from depframe.operators import sequences as S
from depframe.session import table


def line_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = T.split_lines(table(spark, sf_dir, "documents"), "text", ["doc_id"])
    return lines.select("doc_id", F.col("ln").cast("long").alias("ln"), "raw")


def line_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = T.split_lines(table(spark, sf_dir, "documents"), "text", ["lang"])
    norm = T.norm_line(F.col("raw"))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    return lines.groupBy("lang").agg(
        F.count("*").alias("n_lines"), count(T.is_substantive(F.col("raw")))("n_substantive"), count(T.is_case_label(F.col("raw")))("n_labels"),
        count(T.is_head(F.col("raw"), "FOR"))("n_for"), count(T.is_if_start(norm))("n_if"), count(T.is_else(norm))("n_else"),
        count(T.matches_any(F.col("raw"), ["err", "token", "licen"]))("n_keyword"),
    )


def exec_line_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("hit", F.lit(1))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source").join(labelled, "doc_id", "left")
    covered = docs.groupBy("source").agg(F.count("*").alias("total"), F.count("hit").alias("covered"))
    return covered.withColumn("percent", F.when(F.col("total") > 0, F.round(100.0 * F.col("covered") / F.col("total"), 4)).otherwise(F.lit(0.0)))


def first_wins_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.upper(F.regexp_replace("text", r"[ \t\r\n]+", " ")).alias("norm"))
    kept = docs.groupBy(F.sha2("norm", 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    return kept.select("doc_id", "copies")


def quantile_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", "n_chars")
    return S.floor_quantiles(docs, ["lang"], "n_chars", {"q0": 0.0, "q10": 0.1, "q50": 0.5, "q90": 0.9, "q100": 1.0})


def nl_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers, nations = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    named = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "c_name", "n_name")
    rows = orders.join(named, F.col("o_custkey") == F.col("c_custkey"), "left")
    line = F.concat_ws(",", F.concat(F.lit("Order "), F.col("o_orderkey")), F.concat(F.lit("customer "), F.coalesce("c_name", F.lit("unknown"))), F.concat(F.lit("from "), F.coalesce("n_name", F.lit("nowhere"))), F.concat(F.lit("priority "), F.col("o_orderpriority"), F.lit("..")))
    return rows.select("o_orderkey", T.with_period(T.normalised_sentence(T.clipped(line, 80))).alias("sentence"))


def identifier_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every line of every text."""
    lines = T.split_lines(table(spark, sf_dir, "documents"), "text", ["doc_id"])
    names = T.identifiers(F.col("raw"))
    return lines.select("doc_id", F.col("ln").cast("long").alias("ln"), F.size(names).cast("long").alias("n_names"), F.size(F.filter(names, T.is_variable)).cast("long").alias("n_variables"))


def document_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``identifier_sets``, over all lines of each document; no identifier goes over a line's end."""
    names = T.identifiers(F.col("text"))
    docs = table(spark, sf_dir, "documents").where(F.length("text") > 0).select("doc_id", names.alias("names"))
    return docs.select("doc_id", F.size("names").cast("long").alias("n_names"), F.size(F.filter("names", T.is_variable)).cast("long").alias("n_variables"))


QUERIES = {f.__name__: f for f in (line_table, line_predicates, exec_line_coverage, first_wins_dedup, quantile_floor, nl_sentences, identifier_sets, document_identifiers)}

_LINES = r"""SELECT *, unnest(string_split(regexp_replace(text, '\n$', ''), chr(10))) AS raw, generate_subscripts(string_split(regexp_replace(text, '\n$', ''), chr(10)), 1) AS ln FROM documents WHERE length(text) > 0"""
_NORM = r"upper(regexp_replace(regexp_replace(regexp_replace(raw, '\(\*.*?\*\)', '', 'g'), '//.*', '', 'g'), '^\s+|\s+$', '', 'g'))"

ORACLES = {
    "line_table": f"SELECT doc_id, ln, raw FROM ({_LINES})",
    "line_predicates": rf"""
        WITH l AS ({_LINES}), n AS (SELECT lang, raw, {_NORM} AS norm FROM l)
        SELECT lang, count(*) AS n_lines, count(*) FILTER (norm <> '') AS n_substantive,
               count(*) FILTER (regexp_matches(raw, ':([^=]|$)') AND NOT contains(raw, ':=')) AS n_labels,
               count(*) FILTER (regexp_matches(raw, '(?i)^\s*FOR\b')) AS n_for, count(*) FILTER (starts_with(norm, 'IF ')) AS n_if,
               count(*) FILTER (norm = 'ELSE' OR starts_with(norm, 'ELSE ')) AS n_else,
               count(*) FILTER (contains(lower(raw), 'err') OR contains(lower(raw), 'token') OR contains(lower(raw), 'licen')) AS n_keyword
        FROM n GROUP BY lang""",
    "exec_line_coverage": """
        SELECT source, count(*) AS total, count(l.doc_id) AS covered, round(100.0::DOUBLE * count(l.doc_id) / count(*), 4) AS percent
        FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY source""",
    "first_wins_dedup": r"""
        SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY upper(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'))""",
    "quantile_floor": "WITH s AS (SELECT lang, list(n_chars ORDER BY n_chars) AS xs FROM documents GROUP BY lang) SELECT lang, len(xs)::BIGINT AS n, "
    + ", ".join(f"xs[floor({p}::DOUBLE * (len(xs) - 1))::BIGINT + 1] AS q{round(100 * p)}" for p in (0.0, 0.1, 0.5, 0.9, 1.0)) + " FROM s",
    "nl_sentences": r"""
        WITH r AS (SELECT o_orderkey, 'Order ' || o_orderkey || ',customer ' || coalesce(c_name, 'unknown') || ',from ' || coalesce(n_name, 'nowhere') || ',priority ' || o_orderpriority || '..' AS line
                   FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey),
        c AS (SELECT o_orderkey, CASE WHEN length(line) > 80 THEN left(line, 77) || '...' ELSE line END AS line FROM r),
        n AS (SELECT o_orderkey, regexp_replace(regexp_replace(line, ',\s*', ', ', 'g'), '\.{2,}$', '.') AS line FROM c)
        SELECT o_orderkey, CASE WHEN regexp_matches(line, '[.!?:]$') THEN line ELSE line || '.' END AS sentence FROM n""",
    "identifier_sets": rf"""
        WITH l AS ({_LINES}), n AS (SELECT doc_id, ln, list_distinct(regexp_extract_all(raw, '\b[A-Za-z_][0-9A-Za-z_]*\b')) AS names FROM l)
        SELECT doc_id, ln::BIGINT AS ln, len(names) AS n_names,
               len([x FOR x IN names IF upper(x) NOT IN ('TRUE', 'FALSE', 'NAN', 'INF', 'INFINITY')]) AS n_variables FROM n""",
    "document_identifiers": r"""
        WITH n AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '\b[A-Za-z_][0-9A-Za-z_]*\b')) AS names FROM documents WHERE length(text) > 0)
        SELECT doc_id, len(names) AS n_names,
               len([x FOR x IN names IF upper(x) NOT IN ('TRUE', 'FALSE', 'NAN', 'INF', 'INFINITY')]) AS n_variables FROM n""",
}
