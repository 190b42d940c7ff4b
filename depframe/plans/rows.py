"""Queries of criteria, samples, segments, depths and as-of joins over events, pages, lineitem and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from depframe.functions import text as T
from depframe.operators import policy as P
from depframe.operators import sequences as S
from depframe.operators.reports import StageReport
from depframe.session import table

POLICY_FIELDS = ["use_data", "use_control", "device"]


def keyword_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substring classes with precedence: interrupt before error before done."""
    name = F.col("p_name")
    kind = F.when(T.matches_any(name, ["an"]), "runtime_interrupt").when(T.matches_any(name, ["re", "ed"]), "runtime_error").when(T.matches_any(name, ["o"]), "runtime_done")
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(kind, F.lit("none")).alias("kind"))


def kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve most frequent kinds; ties by name."""
    events = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
    return events.orderBy(F.desc("n"), "event_type").limit(12)


def merge_seed_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds of each (user, type), sorted, thinned to eight by their ranks: no more than these are ever gathered."""
    keys = ["user_id", "event_type"]
    seeds = table(spark, sf_dir, "events").select(*keys, "event_id").distinct()
    sizes = seeds.groupBy(*keys).agg(F.count("*").alias("merged_from"))
    thin = S.stride_rows(seeds, keys, ["event_id"], 8).groupBy(*keys).agg(F.sort_array(F.collect_list("event_id")).alias("xs"))
    return thin.join(sizes, keys).select("user_id", F.concat("event_type", F.lit("_set")).alias("kind"), "merged_from", F.array_join(F.col("xs").cast("array<string>"), ",").alias("seeds"))


def sparse_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and middle order of each part; the fifteen with most orders have budget, ties by part. Orders are ranked for these fifteen only."""
    orders = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey").distinct()
    sizes = orders.groupBy("l_partkey").agg(F.count("l_orderkey").alias("n"), F.min("l_orderkey").alias("first_order")).orderBy(F.desc("n"), "l_partkey").limit(15)
    ranked = orders.where("l_orderkey is not null").join(F.broadcast(sizes.select("l_partkey", "n")), "l_partkey").withColumn("i", F.row_number().over(Window.partitionBy("l_partkey").orderBy("l_orderkey")) - 1)
    middle = ranked.where("n >= 3 and i = cast(n / 2 as int)").select("l_partkey", F.col("l_orderkey").alias("middle_order"))
    return sizes.join(middle, "l_partkey", "left").select("l_partkey", "n", "first_order", "middle_order")


def stride_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without urgent orders, every third by key: ranks come from counts per range of keys, so no task sees all of them."""
    customers, orders = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    bare = customers.join(orders, "c_custkey", "left_anti").withColumn("bucket", F.floor(F.col("c_custkey") / 1024))
    sizes = bare.groupBy("bucket").agg(F.count("*").alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = bare.join(sizes, "bucket").withColumn("i", F.row_number().over(Window.partitionBy("bucket").orderBy("c_custkey")) - 1 + F.col("before"))
    return ranked.where("i % 3 = 0").select("c_custkey", F.col("i").cast("long").alias("i"))


def label_join_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names resolve to the last definition; customers' nations are the jumps; what does not resolve has no edge."""
    labels = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.max("n_nationkey").alias("target"))
    nations = table(spark, sf_dir, "nation").join(labels, "n_regionkey").select("n_nationkey", "target")
    return table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("src"), F.col("target").cast("long").alias("dst")).distinct()


def fallthrough_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("src"), F.lead("event_id").over(by).alias("dst")).where("dst is not null")


def def_use_straightline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase uses the last click before it."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    with_def = S.nearest_preceding(events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "click", F.col("event_id"), "def_id")
    return with_def.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("use_id"), "def_id")


def nearest_preceding(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    got = S.nearest_preceding(events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", F.col("event_id"), "signup_id", strict=False)
    return got.select("event_id", "signup_id")


def marker_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return S.marker_segments(events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", 4).select("event_id", F.col("segment").cast("long").alias("segment"))


def gap_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of each user's event numbers: cut at gaps of over 150 from three events on, and after eight."""
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list("event_id")).alias("xs"))
    cut = users.select("user_id", F.posexplode(S.gap_split(F.col("xs"), 150, 3, 8)).alias("segment", "xs"))
    return cut.select("user_id", F.col("segment").cast("long").alias("segment"), F.size("xs").cast("long").alias("n"), F.array_min("xs").alias("first_id"), F.array_max("xs").alias("last_id"))


def stage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and cents of events in three stages: all, those of over 10, of these the first of each user and type; with what each stage lost."""
    report, cents = StageReport(), F.sum(F.round(F.col("value") * 100))
    every = report.written(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value"), "all", cents=cents)
    large = report.written(every.where("value > 10"), "large", cents=cents)
    report.written(S.first_wins(large, ["user_id", "event_type"], ["event_id"]), "first", cents=cents)
    return report.table(spark).withColumn("step", F.col("step").cast("long"))


_TAG_OPEN, _TAG_CLOSE = r"<(p|div|li|ul|table|section)\b", r"</(p|div|li|ul|table|section)>"


def _tag_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.split("html", "<", -1)).alias("ln", "raw"))
    raw = F.concat(F.lit("<"), F.col("raw"))
    return pieces.select("page_id", "ln", raw.rlike(_TAG_OPEN).cast("int").alias("heads"), raw.rlike(_TAG_CLOSE).cast("int").alias("ends"))


def running_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deepest nesting and what is left open, the counter clamped at 0."""
    rows = S.running_depth(_tag_lines(spark, sf_dir), ["page_id"], ["ln"], "ends", "heads")
    return rows.groupBy("page_id").agg(F.max("depth").cast("long").alias("deepest"), F.max_by("depth", "ln").cast("long").alias("left_open"))


def match_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tag_lines(spark, sf_dir).where("heads + ends > 0")
    found = S.matching_end(rows, ["page_id"], "ln", "heads", "ends")
    return found.select("page_id", F.col("start").cast("long").alias("start_at"), F.col("end").cast("long").alias("end_at"))


def interval_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors within a user's span from one signup to the next pull in both ends."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    by = Window.partitionBy("user_id").orderBy("event_id")
    spans = events.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("start"), F.lead("event_id").over(by).alias("end")).where("end is not null")
    return S.interval_patch(events.where("event_type = 'error'"), spans, ["user_id"], "event_id")


def meaningful_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations of three turns and more with a turn of the assistant."""
    groups = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.max((F.col("role") == "assistant").cast("int")).alias("acts"))
    return groups.where("n_turns >= 3 and acts = 1").select("conv_id", "n_turns")


def render_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = table(spark, sf_dir, "conversations")
    return S.rendered(talk, ["conv_id"], ["turn"], F.concat("role", F.lit(": "), F.coalesce("text", F.lit(""))), "block")


def policy_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults by type, overridden by what an event's properties name."""
    defaults = spark.createDataFrame([("click", (True, False, None)), ("view", (True, True, "any")), ("error", (False, True, None))], "kind string, settings struct<use_data:boolean,use_control:boolean,device:string>")
    events = table(spark, sf_dir, "events").select("event_id", "event_type", F.from_json("props", "use_data boolean, use_control boolean, device string").alias("own"))
    got = P.resolved(events, defaults, "event_type", F.col("own"), POLICY_FIELDS)
    return got.select("event_id", F.col("policy.use_data").alias("use_data"), F.col("policy.use_control").alias("use_control"), F.col("policy.device").alias("device"))


QUERIES = {
    f.__name__: f
    for f in (
        keyword_criteria, kind_counts, merge_seed_sets, sparse_pick, stride_fill, label_join_edges, fallthrough_edges, def_use_straightline, nearest_preceding,
        marker_segments, gap_split, running_depth, match_end, interval_patch, meaningful_blocks, render_block, policy_merge, stage_report,
    )
}

_TAGS = r"""
    p AS (SELECT page_id, unnest(string_split(html, '<')) AS raw, generate_subscripts(string_split(html, '<'), 1) - 1 AS ln FROM pages),
    t AS (SELECT page_id, ln, regexp_matches('<' || raw, '<(p|div|li|ul|table|section)\b')::INT AS heads, regexp_matches('<' || raw, '</(p|div|li|ul|table|section)>')::INT AS ends FROM p)"""

ORACLES = {
    "stage_report": """
        WITH l AS (SELECT * FROM events WHERE value > 10), f AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1),
        t AS (SELECT 0 AS step, 'all' AS stage, count(*)::DOUBLE AS "rows", sum(round(value * 100)) AS cents FROM events
              UNION ALL SELECT 1, 'large', count(*), sum(round(value * 100)) FROM l UNION ALL SELECT 2, 'first', count(*), sum(round(value * 100)) FROM f),
        m AS (SELECT step, stage, 'rows' AS measure, "rows" AS value FROM t UNION ALL SELECT step, stage, 'cents', cents FROM t)
        SELECT step::BIGINT AS step, stage, measure, value, value - lag(value) OVER (PARTITION BY measure ORDER BY step) AS change FROM m""",
    "keyword_criteria": """
        SELECT p_partkey, CASE WHEN contains(lower(p_name), 'an') THEN 'runtime_interrupt' WHEN contains(lower(p_name), 're') OR contains(lower(p_name), 'ed') THEN 'runtime_error'
               WHEN contains(lower(p_name), 'o') THEN 'runtime_done' ELSE 'none' END AS kind FROM part""",
    "kind_counts": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 12",
    "merge_seed_sets": """
        WITH g AS (SELECT user_id, event_type, list_sort(list(DISTINCT event_id)) AS xs FROM events GROUP BY 1, 2)
        SELECT user_id, event_type || '_set' AS kind, len(xs)::BIGINT AS merged_from,
               array_to_string([xs[i + 1] FOR i IN range(len(xs)) IF i % greatest(1, len(xs) // 8) = 0][1:8], ',') AS seeds FROM g""",
    "sparse_pick": """
        WITH g AS (SELECT l_partkey, list_sort(list(DISTINCT l_orderkey)) AS xs FROM lineitem GROUP BY 1)
        SELECT l_partkey, len(xs)::BIGINT AS n, xs[1] AS first_order, CASE WHEN len(xs) >= 3 THEN xs[len(xs) // 2 + 1] END AS middle_order
        FROM g ORDER BY n DESC, l_partkey LIMIT 15""",
    "stride_fill": """
        WITH b AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT'))
        SELECT c_custkey, i FROM b WHERE i % 3 = 0""",
    "label_join_edges": """
        WITH l AS (SELECT n_regionkey, max(n_nationkey) AS target FROM nation GROUP BY 1)
        SELECT DISTINCT c_custkey AS src, target::BIGINT AS dst FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN l USING (n_regionkey)""",
    "fallthrough_edges": "SELECT * FROM (SELECT user_id, event_id AS src, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL",
    "def_use_straightline": """
        SELECT u.user_id, u.event_id AS use_id, arg_max(d.event_id, (d.ts, d.event_id)) AS def_id FROM events u
        LEFT JOIN events d ON d.user_id = u.user_id AND d.event_type = 'click' AND (d.ts < u.ts OR d.ts = u.ts AND d.event_id < u.event_id)
        WHERE u.event_type = 'purchase' GROUP BY 1, 2""",
    "nearest_preceding": """
        SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS signup_id FROM events""",
    "marker_segments": """
        WITH s AS (SELECT *, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS seg FROM events),
        n AS (SELECT user_id, seg, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY seg) AS r FROM s GROUP BY 1, 2),
        o AS (SELECT user_id, seg, sum((r = 1 OR n >= 4)::INT) OVER (PARTITION BY user_id ORDER BY seg ROWS UNBOUNDED PRECEDING) AS segment FROM n)
        SELECT event_id, segment::BIGINT AS segment FROM s JOIN o USING (user_id, seg)""",
    "gap_split": """
        WITH RECURSIVE e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
        r AS (SELECT user_id, event_id, i, 0 AS segment, 1 AS held FROM e WHERE i = 1
              UNION ALL
              SELECT e.user_id, e.event_id, e.i,
                     CASE WHEN r.held >= 8 OR r.held >= 3 AND e.event_id - r.event_id > 150 THEN r.segment + 1 ELSE r.segment END,
                     CASE WHEN r.held >= 8 OR r.held >= 3 AND e.event_id - r.event_id > 150 THEN 1 ELSE r.held + 1 END
              FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
        SELECT user_id, segment::BIGINT AS segment, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM r GROUP BY 1, 2""",
    "running_depth": f"""
        WITH {_TAGS},
        s AS (SELECT *, sum(heads - ends) OVER (PARTITION BY page_id ORDER BY ln ROWS UNBOUNDED PRECEDING) AS s FROM t),
        d AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY page_id ORDER BY ln ROWS UNBOUNDED PRECEDING)) AS depth FROM s)
        SELECT page_id, max(depth)::BIGINT AS deepest, arg_max(depth, ln)::BIGINT AS left_open FROM d GROUP BY page_id""",
    "match_end": f"""
        WITH {_TAGS},
        s AS (SELECT *, sum(heads - ends) OVER (PARTITION BY page_id ORDER BY ln ROWS UNBOUNDED PRECEDING) AS after FROM t)
        SELECT a.page_id, a.ln AS start_at, min(b.ln) AS end_at FROM s a JOIN s b ON a.page_id = b.page_id AND b.ln >= a.ln AND b.ends > 0 AND b.after = a.after - a.heads + a.ends
        WHERE a.heads > 0 GROUP BY 1, 2""",
    "interval_patch": """
        WITH s AS (SELECT user_id, event_id AS a, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events WHERE event_type = 'signup'),
        h AS (SELECT user_id, event_id FROM events WHERE event_type = 'error')
        SELECT user_id, event_id FROM h
        UNION SELECT user_id, unnest([a, b]) FROM s WHERE b IS NOT NULL AND EXISTS (SELECT 1 FROM h WHERE h.user_id = s.user_id AND h.event_id BETWEEN a AND b)""",
    "meaningful_blocks": "SELECT conv_id, count(*) AS n_turns FROM conversations GROUP BY 1 HAVING count(*) >= 3 AND bool_or(role = 'assistant')",
    "render_block": "SELECT conv_id, string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS block FROM conversations GROUP BY 1",
    "policy_merge": """
        WITH d(kind, use_data, use_control, device) AS (VALUES ('click', true, false, NULL), ('view', true, true, 'any'), ('error', false, true, NULL))
        SELECT event_id, coalesce((props->>'use_data')::BOOLEAN, d.use_data) AS use_data, coalesce((props->>'use_control')::BOOLEAN, d.use_control) AS use_control,
               coalesce(props->>'device', d.device) AS device FROM events LEFT JOIN d ON kind = event_type""",
}
