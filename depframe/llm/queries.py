"""The queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depframe.llm import ball_clusters, collocations, jaccard_join, line_dedup, media_columns, packing, quality_classifier, quality_rules, secret_scan, sentence_pieces, suffix_dedup, token_counts, url_filters
from depframe.session import scratch_path, table

#: Fixed values. (verdict, host, path) of the URL rules.
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache is new for each call, so that what a call costs does not hang on earlier ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.token_counts(docs, vocabulary("byte_bpe_50k.json"), scratch_path(spark, "token-cache"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = media_columns.media_columns(table(spark, sf_dir, "documents").select("doc_id", "text"))
    payload, stored = F.col("payload"), F.col("media")
    return media.select(
        F.col("key").alias("doc_id"), "n_bytes",
        F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -64, 64)).alias("tail_crc32"),
        F.octet_length(stored).cast("long").alias("media_bytes"), F.sha2(stored, 256).alias("media_sha256"), "feature",
    )


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.span_report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of what they decode to; ids_sha256 is of their decimal numbers joined by blanks."""
    model = sentence_pieces.PieceModel.load(vocabulary("piece_bpe_32k.model"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentence_pieces.digest_columns(docs, model).select("doc_id", "n_ids", "n_byte_ids", "ids_sha256", "decoded_sha256", "round_trip")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    packed = packing.pack(docs, vocabulary("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality_rules.quality_rules(docs).select("doc_id", "quality.*")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = jaccard_join.jaccard_classes(table(spark, sf_dir, "documents").select("doc_id", "text"), words=4, num=85, den=100)
    return classes.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list holds the canonical URLs of pages of mangled text, those with a doubled mark in their html, in another spelling than the pages' own."""
    pages = table(spark, sf_dir, "pages")
    respelt = F.concat(F.lit("HTTP://"), F.upper(url_filters.url_host(F.col("url"))), F.lit(":80"), url_filters.url_path(F.col("url")), F.lit("/?utm_medium=list"))
    query = F.regexp_extract("url", r"\?([^#]*)", 1)
    listed = pages.where(F.col("html").contains("###")).select(F.concat(respelt, F.when(query != "", F.concat(F.lit("&"), query)).otherwise("")).alias("listed"))
    listed = listed.select(url_filters.canonical_url(F.col("listed")).alias("canonical"))
    return url_filters.url_filter(pages.select("page_id", "url"), URL_RULES, listed).select("page_id", "host", "path", "rule", "verdict")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality_classifier.fit_quality(docs, labels)
    scored = quality_classifier.score_quality(docs, model)
    return scored.select("doc_id", quality_classifier.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2("lines.kept", 256).alias("kept_sha256"))


def op12_ball_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_clusters.ball_clusters(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_media_columns": op2_media_columns,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_secret_scan": op4_secret_scan,
    "op5_sentence_pieces": op5_sentence_pieces,
    "op6_packing": op6_packing,
    "op7_quality_rules": op7_quality_rules,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_url_filters": op9_url_filters,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_line_dedup": op11_line_dedup,
    "op12_ball_clusters": op12_ball_clusters,
    "op13_collocations": op13_collocations,
}

#: Five rounds of assignment and exact means in integers; CTEs are materialised, as each is read several times.
_NEAREST = """a{i} AS MATERIALIZED (SELECT vec_id, v, d.cluster AS cluster, d.d AS distance FROM (
    SELECT vec_id, v, min(struct_pack(d := list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, cluster := cluster)) AS d FROM k, c{i} GROUP BY vec_id, v))"""
_MEANS = """c{j} AS MATERIALIZED (SELECT cluster, coalesce(m, c) AS c FROM c{i} LEFT JOIN (
    SELECT cluster, list(m ORDER BY d) AS m FROM (SELECT cluster, d, floor(sum(x) / count(*)::DOUBLE)::BIGINT AS m FROM (
        SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM a{i}) GROUP BY cluster, d) GROUP BY cluster) USING (cluster))"""
_BALLS = ", ".join(_NEAREST.format(i=i) + ", " + _MEANS.format(i=i, j=i + 1) for i in range(5)) + ", " + _NEAREST.format(i=5)

ORACLES: dict[str, str] = {
    "op11_line_dedup": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), s AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM t),
        l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM s),
        k AS (SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l),
        f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (key IN (SELECT key FROM f)) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (key NOT IN (SELECT key FROM f)), '')) AS kept_sha256 FROM k GROUP BY doc_id""",
    "op13_collocations": r"""
        WITH d AS (SELECT coalesce(lang, 'und') AS lang, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\n\x0b\x0c\r]')) AS piece FROM d),
        w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS ws FROM p),
        n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
        g AS (SELECT lang, ws[i:i + m - 1] AS ph FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, (VALUES (1), (2), (3), (4), (5)) s(m))),
        f AS MATERIALIZED (SELECT lang, ph, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
        c AS (SELECT lang, ph, f AS a, unnest(range(1, len(ph))) AS k FROM f WHERE len(ph) > 1),
        s AS (SELECT c.lang, c.ph, c.a, k, l.f AS l, r.f AS r, n, ((1000::HUGEINT * c.a * n) // (l.f::HUGEINT * r.f))::BIGINT AS score
              FROM c JOIN n USING (lang) JOIN f l ON l.lang = c.lang AND l.ph = c.ph[1:k] JOIN f r ON r.lang = c.lang AND r.ph = c.ph[k + 1:]),
        b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) = 1),
        v AS (SELECT lang, ph[2:] AS ph, f FROM f WHERE len(ph) > 2 UNION ALL SELECT lang, ph[:-2], f FROM f WHERE len(ph) > 2),
        u AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.lang = b.lang AND v.ph = b.ph AND v.f >= b.a)),
        q AS (SELECT lang, array_to_string(ph, ' ') AS phrase, a, l, r, n, score FROM u)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM q
        QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000""",
    "op12_ball_clusters": f"""
        WITH k AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
              WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
        c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h) - 1)::INT AS cluster, v AS c FROM (SELECT v, sha256('2:' || vec_id) AS h FROM k ORDER BY h LIMIT 40)),
        {_BALLS},
        s AS (SELECT cluster, sum(distance)::BIGINT AS cluster_inertia FROM a5 GROUP BY cluster)
        SELECT vec_id, cluster, distance, cluster_inertia, (SELECT sum(cluster_inertia)::BIGINT FROM s) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a5 JOIN s USING (cluster) JOIN c5 USING (cluster)""",
    "op9_url_filters": r"""
        WITH u AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        r AS (SELECT * FROM (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')) t(kind, rule_host, rule_path)),
        m AS (SELECT page_id, max_by(struct_pack(kind := kind, rule := rule_host || rule_path), length(rule_host) * 1000 + length(rule_path)) AS best
              FROM h JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id),
        c AS (SELECT page_id, html, regexp_replace(h.host, ':(80|443)$', '') || regexp_replace(h.path, '/+$', '') AS bare,
                     list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) AS kept
              FROM pages JOIN h USING (page_id) WHERE url LIKE '%://%'),
        k AS (SELECT page_id, html, bare || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical FROM c),
        listed AS (SELECT DISTINCT canonical FROM k WHERE contains(html, '###'))
        SELECT h.page_id, host, path, best.rule AS rule, coalesce(best.kind, CASE WHEN listed.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
        FROM h LEFT JOIN m USING (page_id) LEFT JOIN k USING (page_id) LEFT JOIN listed USING (canonical)""",
}
