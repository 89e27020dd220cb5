"""Opinion queries: current annotations, attitudes, themes, stages, evidence, competitors."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chatterscope.functions import calendar as C
from chatterscope.functions import metrics as M
from chatterscope.operators import facts as T
from chatterscope.operators import reviews
from chatterscope.plans.catalog import query
from chatterscope.sources import bindings as B

KEYS = ["target_id", "subject_code"]
D7 = C.build_range("d7", B.ANCHOR)
D14 = C.build_range("d14", B.ANCHOR)
ENDS = "ends AS (SELECT * FROM annotations a WHERE NOT EXISTS (SELECT 1 FROM annotations b WHERE b.supersedes_id = a.annotation_id))"
CURRENT = (
    B.ctes("feeds", "comments", "products", "annotations")
    + f", {ENDS}, cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_id, subject_code ORDER BY CASE WHEN review_state IN ('approved','corrected') THEN 1 ELSE 0 END DESC, created_at DESC, annotation_id DESC) AS r FROM ends WHERE review_state <> 'rejected') WHERE r = 1)"
)
JOBS = "jobs AS (SELECT event_id AS job_id, event_id - event_id % 2 AS target_id, event_type AS subject_code, CASE k % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'dead' WHEN 2 THEN 'running' ELSE 'done' END AS status, k % 40 AS priority, k % 4 AS attempts, ts AS created_at, ts + INTERVAL 30 MINUTE AS lease_until FROM ev)"
LO7, HI7 = C.utc_bounds(D7)
#: Units of opinion: current, relevant, timed by the post they are under.
UNITS = f"{CURRENT}, u AS (SELECT cur.*, f.posted_at, f.code FROM cur JOIN feeds f USING (feed_id) WHERE relevance = 'relevant')"
DAY7 = f"CAST(date_diff('day', DATE '{D7.first}', CAST(posted_at + INTERVAL 8 HOUR AS DATE)) AS INTEGER)"
IN7 = f"posted_at >= TIMESTAMP '{LO7}' AND posted_at < TIMESTAMP '{HI7}'"
LO14, HI14 = C.utc_bounds(D14)
IN14 = f"posted_at >= TIMESTAMP '{LO14}' AND posted_at < TIMESTAMP '{HI14}'"
LOB, HIB = C.utc_bounds(D7.baseline())
INB = f"posted_at >= TIMESTAMP '{LOB}' AND posted_at < TIMESTAMP '{HIB}'"


def jobs(spark, sf):
    k = F.col("k")
    return B._events(spark, sf).select(
        F.col("event_id").alias("job_id"), (F.col("event_id") - F.col("event_id") % 2).alias("target_id"), F.col("event_type").alias("subject_code"),
        F.when(k % 5 == 0, "pending").when(k % 5 == 1, "dead").when(k % 5 == 2, "running").otherwise("done").alias("status"), (k % 40).alias("priority"), (k % 4).alias("attempts"),
        F.col("ts").alias("created_at"), (F.col("ts") + F.expr("INTERVAL 30 MINUTES")).alias("lease_until"),
    )


def units(spark, sf, r=None):
    """Relevant current annotations with their post's time and product: parent-time attribution."""
    feeds = B.feeds(spark, sf).select("feed_id", "posted_at", "code")
    feeds = feeds.where(C.in_window(F.col("posted_at"), r)) if r else feeds
    return T.current(B.annotations(spark, sf), KEYS).where("relevance = 'relevant'").join(feeds, "feed_id")


def tri(c="attitude", names=("positive", "negative", "neutral")):
    return [F.count_if(F.col(c) == n).alias(n) for n in names]


@query("j7_chain_ends", B.ctes("annotations") + f", {ENDS} SELECT subject_code, count(*) AS n, CAST(sum(annotation_id) AS BIGINT) AS ids FROM ends GROUP BY 1")
def chain_ends(spark, sf):
    return T.chain_ends(B.annotations(spark, sf)).groupBy("subject_code").agg(F.count(F.lit(1)).alias("n"), F.sum("annotation_id").alias("ids"))


@query("v2_w5_current_annotations", CURRENT + " SELECT target_id, subject_code, annotation_id, attitude, review_state FROM cur")
def current_annotations(spark, sf):
    return T.current(B.annotations(spark, sf), KEYS).select(*KEYS, "annotation_id", "attitude", "review_state")


@query("v3_released_annotations", CURRENT + f", {JOBS}, lj AS (SELECT target_id, subject_code, arg_max(status, job_id) AS status FROM jobs GROUP BY 1, 2) SELECT cur.target_id, cur.subject_code, cur.annotation_id FROM cur LEFT JOIN lj USING (target_id, subject_code) WHERE provider <> 'rule' AND prompt_version IN ('p0','p1') AND (lj.status IS NULL OR lj.status = 'done')")
def released_annotations(spark, sf):
    return T.released(B.annotations(spark, sf), KEYS, jobs(spark, sf), ["p0", "p1"]).select(*KEYS, "annotation_id")


@query("j9_latest_job", B.ctes() + f", {JOBS} SELECT target_id, subject_code, max(job_id) AS job_id, arg_max(status, job_id) AS status FROM jobs GROUP BY 1, 2")
def latest_job(spark, sf):
    return T.latest_per(jobs(spark, sf).select(*KEYS, "job_id", "status"), KEYS, [F.col("job_id")])


#: A log of reviews over all events: runs of 21 events in id order are chains, each event correcting the one before it. Some
#: decisions reject, some say another value, some rows are not settled or of another input, and every tenth chain is a circle.
REVIEWS = (
    B.ctes()
    + """, raw AS (SELECT *, event_id % 21 AS pos, event_id // 21 AS chain, max(event_id) OVER (PARTITION BY event_id // 21) AS tail FROM ev),
log AS (SELECT event_id AS annotation_id, 'comment' AS target_type, chain AS target_id, 'p' || CAST(chain % 5 AS VARCHAR) AS subject_code, 'attitude' AS kind,
  '{"v": ' || CAST(k % 3 AS VARCHAR) || ', "n": "' || event_type || '"}' AS value_json, CASE WHEN k % 53 = 0 THEN 'pending' WHEN k % 2 = 0 THEN 'approved' ELSE 'corrected' END AS review_state,
  CASE WHEN pos > 0 OR chain % 10 = 9 THEN 'review:' || CASE WHEN k % 71 = 0 THEN '0' ELSE '' END || CAST(event_id + 1 AS VARCHAR) ELSE 'run-' || CAST(chain % 3 AS VARCHAR) END AS run_id,
  CASE WHEN k % 61 = 0 THEN 'other' ELSE 'h' || CAST(chain AS VARCHAR) END AS input_hash,
  CASE WHEN pos > 0 THEN event_id - 1 WHEN chain % 10 = 9 THEN tail END AS supersedes_id, k, event_type FROM raw),
decisions AS (SELECT annotation_id + 1 AS decision_id, supersedes_id AS annotation_id, CASE WHEN k % 67 = 0 THEN 'reject' ELSE 'correct' END AS decision,
  CASE WHEN k % 59 = 0 THEN NULL WHEN k % 47 = 0 THEN '{"v": 9}' ELSE '{"n":"' || event_type || '","v":' || CAST(k % 3 AS VARCHAR) || '}' END AS corrected_value_json FROM log WHERE supersedes_id IS NOT NULL)"""
)
#: The same walk in SQL, hop by hop with the decisions seen so far.
ORIGINS = (
    REVIEWS.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, hop AS (SELECT a.annotation_id, b.annotation_id AS before FROM log a JOIN decisions d ON a.run_id = 'review:' || CAST(d.decision_id AS VARCHAR) AND d.decision = 'correct' AND d.annotation_id = a.supersedes_id
  JOIN log b ON b.annotation_id = d.annotation_id AND b.target_type = a.target_type AND b.target_id = a.target_id AND b.subject_code = a.subject_code AND b.kind = a.kind AND b.input_hash = a.input_hash
  WHERE a.review_state IN ('approved', 'corrected') AND json_extract_string(a.value_json, '$.v') IS NOT DISTINCT FROM json_extract_string(d.corrected_value_json, '$.v') AND json_extract_string(a.value_json, '$.n') IS NOT DISTINCT FROM json_extract_string(d.corrected_value_json, '$.n')),
walk AS (SELECT annotation_id, annotation_id AS at, 0 AS hops, [annotation_id] AS seen FROM log
  UNION ALL SELECT w.annotation_id, h.before, hops + 1, list_append(seen, h.before) FROM walk w JOIN hop h ON h.annotation_id = w.at WHERE NOT list_contains(seen, h.before)),
origins AS (SELECT w.annotation_id, w.at AS origin_id, l.run_id AS origin_run, CAST(hops AS BIGINT) AS hops FROM walk w JOIN log l ON l.annotation_id = w.at AND l.run_id NOT LIKE 'review:%')"""
)


def review_log(spark, sf):
    """(log, decisions) as in the SQL above."""
    e = B._events(spark, sf).withColumns({"pos": F.col("event_id") % 21, "chain": F.floor(F.col("event_id") / 21)})
    tails = e.groupBy("chain").agg(F.max("event_id").alias("tail"))
    e = e.join(tails, "chain")
    k, chain, text = F.col("k"), F.col("chain"), lambda c: c.cast("string")
    log = e.select(
        F.col("event_id").alias("annotation_id"), F.lit("comment").alias("target_type"), chain.alias("target_id"), F.concat(F.lit("p"), text(chain % 5)).alias("subject_code"), F.lit("attitude").alias("kind"),
        F.concat(F.lit('{"v": '), text(k % 3), F.lit(', "n": "'), "event_type", F.lit('"}')).alias("value_json"), F.when(k % 53 == 0, "pending").when(k % 2 == 0, "approved").otherwise("corrected").alias("review_state"),
        F.when((F.col("pos") > 0) | (chain % 10 == 9), F.concat(F.lit("review:"), F.when(k % 71 == 0, "0").otherwise(""), text(F.col("event_id") + 1))).otherwise(F.concat(F.lit("run-"), text(chain % 3))).alias("run_id"),
        F.when(k % 61 == 0, "other").otherwise(F.concat(F.lit("h"), text(chain))).alias("input_hash"),
        F.when(F.col("pos") > 0, F.col("event_id") - 1).when(chain % 10 == 9, F.col("tail")).alias("supersedes_id"), "k", "event_type",
    )
    said = F.concat(F.lit('{"n":"'), "event_type", F.lit('","v":'), text(k % 3), F.lit("}"))
    decisions = log.where("supersedes_id is not null").select(
        (F.col("annotation_id") + 1).alias("decision_id"), F.col("supersedes_id").alias("annotation_id"), F.when(k % 67 == 0, "reject").otherwise("correct").alias("decision"),
        F.when(k % 59 == 0, None).when(k % 47 == 0, '{"v": 9}').otherwise(said).alias("corrected_value_json"),
    )
    return log, decisions


@query("v4_review_origin", ORIGINS + " SELECT l.annotation_id, origin_id, origin_run, hops FROM log l LEFT JOIN origins USING (annotation_id)")
def review_origin(spark, sf):
    """Every row's origin through chains of up to twenty corrections, some broken and some circles."""
    return reviews.origins(*review_log(spark, sf))


@query(
    "v3_v4_released_by_origin",
    ORIGINS + ", ends AS (SELECT * FROM log a WHERE NOT EXISTS (SELECT 1 FROM log b WHERE b.supersedes_id = a.annotation_id)) SELECT e.annotation_id, origin_id, hops FROM ends e JOIN origins USING (annotation_id) WHERE review_state <> 'rejected' AND origin_run IN ('run-0', 'run-2')",
)
def released_by_origin(spark, sf):
    """Chain ends whose first run is one of the allowed ones, however often they were corrected since."""
    log, decisions = review_log(spark, sf)
    allowed = spark.createDataFrame([("run-0",), ("run-2",)], "run_id string")
    current = T.chain_ends(log).where("review_state <> 'rejected'").select("annotation_id")
    return reviews.released(current, reviews.origins(log, decisions), allowed).select("annotation_id", "origin_id", "hops")


@query("j8_review_queue", B.ctes("annotations") + " SELECT subject_code, count(*) AS n FROM annotations WHERE review_state = 'pending' AND annotation_id NOT IN (SELECT supersedes_id FROM annotations WHERE supersedes_id IS NOT NULL) GROUP BY 1")
def review_queue(spark, sf):
    return T.chain_ends(B.annotations(spark, sf)).where("review_state = 'pending'").groupBy("subject_code").agg(F.count(F.lit(1)).alias("n"))


@query("a5_a18_attitude_counts", UNITS + f", s AS (SELECT DISTINCT code FROM u), c AS (SELECT code, count(*) FILTER (attitude = 'positive') AS positive, count(*) FILTER (attitude = 'negative') AS negative, count(*) FILTER (attitude = 'neutral') AS neutral FROM u WHERE {IN7} GROUP BY 1) SELECT p.code, CASE WHEN s.code IS NOT NULL AND p.code <> 'signup' THEN coalesce(positive, 0) END AS positive, CASE WHEN s.code IS NOT NULL AND p.code <> 'signup' THEN coalesce(negative, 0) END AS negative, CASE WHEN s.code IS NOT NULL AND p.code <> 'signup' THEN coalesce(neutral, 0) END AS neutral FROM products p LEFT JOIN s USING (code) LEFT JOIN c ON c.code = p.code")
def attitude_counts(spark, sf):
    """Null for products that were never analysed, 0 inside those that were."""
    seen = units(spark, sf).where("code <> 'signup'").select("code").distinct().withColumn("_seen", F.lit(True))
    counts = units(spark, sf, D7).groupBy("code").agg(*tri())
    out = B.products(spark, sf).select("code").join(seen, "code", "left").join(counts, "code", "left")
    return out.select("code", *[F.when(F.col("_seen"), F.coalesce(c, F.lit(0))).alias(c) for c in ("positive", "negative", "neutral")])


@query("f6_product_opinion", UNITS + f", c AS (SELECT code, count(*) FILTER (attitude = 'positive') AS p, count(*) FILTER (attitude = 'negative') AS n FROM u WHERE {IN7} GROUP BY 1) SELECT code, CASE WHEN p + n < 10 THEN 'low_sample' WHEN p > n THEN CASE WHEN (p - n) * 4 >= p + n THEN 'positive' ELSE 'neutral_positive' END WHEN p < n THEN CASE WHEN (n - p) * 4 >= p + n THEN 'negative' ELSE 'neutral_negative' END ELSE 'neutral' END AS opinion, p + n >= 10 AS sufficient FROM c")
def product_opinion(spark, sf):
    c = units(spark, sf, D7).groupBy("code").agg(*tri())
    return c.select("code", M.product_opinion(F.col("positive"), F.col("negative"), F.col("neutral")).alias("opinion"), M.sample_sufficient(F.col("positive"), F.col("negative")).alias("sufficient"))


@query(
    "a17_f7_market_topic",
    UNITS + f", b AS (SELECT code, {DAY7} AS bucket, count(*) FILTER (market = 'bullish') AS p, count(*) FILTER (market = 'bearish') AS n, count(*) FILTER (market = 'none') AS z FROM u WHERE {IN7} GROUP BY 1, 2), t AS (SELECT code, sum(p) AS p, sum(n) AS n, sum(z) AS z, arg_max(bucket, (p + n) * 1000 - bucket) AS peak FROM b GROUP BY 1) SELECT code, CAST(p AS BIGINT) AS bullish, CAST(n AS BIGINT) AS bearish, CAST(z AS BIGINT) AS neutral, peak, CASE WHEN p + n + z <= 0 THEN NULL WHEN p > n THEN CASE WHEN (p - n) * 4 >= p + n + z THEN 'bullish' ELSE 'neutral_bullish' END WHEN p < n THEN CASE WHEN (n - p) * 4 >= p + n + z THEN 'bearish' ELSE 'neutral_bearish' END ELSE 'neutral' END AS sentiment FROM t",
)
def market_topic(spark, sf):
    names = ("bullish", "bearish", "none")
    b = units(spark, sf, D7).groupBy("code", C.bucket(F.col("posted_at"), D7).alias("bucket")).agg(*tri("market", names))
    said = F.col("bullish") + F.col("bearish")
    t = b.groupBy("code").agg(*[F.sum(n).alias(n) for n in names], F.max_by("bucket", F.struct(said, -F.col("bucket"))).alias("peak"))
    return t.select("code", "bullish", "bearish", F.col("none").alias("neutral"), "peak", M.market_sentiment(F.col("bullish"), F.col("bearish"), F.col("none")).alias("sentiment"))


ASPECT = "CASE WHEN aspect = '' THEN 'other' ELSE aspect END"


@query("a13_theme_counts", UNITS + f" SELECT code, {ASPECT} AS aspect, count(*) AS comment_count, count(DISTINCT feed_id) AS mentions, min(posted_at) AS first_at, max(posted_at) AS last_at FROM u WHERE {IN7} GROUP BY 1, 2")
def theme_counts(spark, sf):
    return themes(units(spark, sf, D7), ["code"])


def themes(rows, keys):
    """Per aspect: rows, distinct threads, first and last time; an empty aspect is ``other``."""
    aspect = F.when(F.col("aspect") == "", "other").otherwise(F.col("aspect")).alias("aspect")
    return rows.groupBy(*keys, aspect).agg(F.count(F.lit(1)).alias("comment_count"), F.count_distinct("feed_id").alias("mentions"), F.min("posted_at").alias("first_at"), F.max("posted_at").alias("last_at"))


@query("a14_theme_table", UNITS + f", t AS (SELECT code, attitude, {ASPECT} AS aspect, count(DISTINCT feed_id) AS mentions FROM u WHERE {IN7} GROUP BY 1, 2, 3), d AS (SELECT code, attitude, count(DISTINCT feed_id) AS threads FROM u WHERE {IN7} GROUP BY 1, 2) SELECT code, attitude, aspect, mentions, round(CAST(mentions AS DOUBLE) / threads * 100, 6) AS share FROM t JOIN d USING (code, attitude)")
def theme_table(spark, sf):
    rows = units(spark, sf, D7)
    whole = rows.groupBy("code", "attitude").agg(F.count_distinct("feed_id").alias("threads"))
    out = themes(rows, ["code", "attitude"]).join(whole, ["code", "attitude"])
    return out.select("code", "attitude", "aspect", "mentions", F.round(F.col("mentions") / F.col("threads") * 100, 6).alias("share"))


NEGATIVE = (
    UNITS
    + f""", c AS (SELECT code, {ASPECT} AS aspect, count(DISTINCT feed_id) AS mentions FROM u WHERE attitude = 'negative' AND {IN7} GROUP BY 1, 2), o AS (SELECT code, {ASPECT} AS aspect, count(DISTINCT feed_id) AS base FROM u WHERE attitude = 'negative' AND {INB} GROUP BY 1, 2),
 d AS (SELECT code, count(DISTINCT feed_id) AS threads FROM u WHERE attitude = 'negative' AND {IN7} GROUP BY 1),
 n AS (SELECT code, aspect, mentions, coalesce(base, 0) AS base, CASE WHEN coalesce(base, 0) = 0 THEN CASE WHEN mentions > 0 THEN 'new' END WHEN mentions * 10 < base * 7 THEN 'fading' ELSE 'continuing' END AS lifecycle, CAST(mentions AS DOUBLE) / threads * 100 AS share FROM c LEFT JOIN o USING (code, aspect) JOIN d USING (code)),
 s AS (SELECT *, CASE WHEN share >= 25 AND lifecycle IS DISTINCT FROM 'fading' THEN 'high' WHEN share >= 12 THEN 'medium' ELSE 'low' END AS severity, row_number() OVER (PARTITION BY code ORDER BY mentions DESC, aspect) AS r FROM n)"""
)


def negatives(spark, sf):
    """The window and its baseline adjoin: one pass over both, parted by a flag."""
    rows = units(spark, sf, C.Range(D7.baseline().first, D7.last)).where("attitude = 'negative'")
    now = C.in_window(F.col("posted_at"), D7)
    rows = rows.select("code", F.when(F.col("aspect") == "", "other").otherwise(F.col("aspect")).alias("aspect"), F.when(now, F.col("feed_id")).alias("_cur"), F.when(~now, F.col("feed_id")).alias("_old"))
    whole = rows.groupBy("code").agg(F.count_distinct("_cur").alias("_threads"))
    out = rows.groupBy("code", "aspect").agg(F.count_distinct("_cur").alias("mentions"), F.count_distinct("_old").alias("base")).where("mentions > 0").join(whole, "code")
    out = out.withColumn("lifecycle", M.lifecycle(F.col("mentions"), F.col("base")))
    out = out.withColumn("severity", M.severity(F.col("mentions") / F.col("_threads") * 100, F.col("lifecycle")))
    return out.withColumn("place", F.row_number().over(W.partitionBy("code").orderBy(F.desc("mentions"), "aspect"))).select("code", "aspect", "mentions", "base", "lifecycle", "severity", "place")


@query("a15_negative_categories", NEGATIVE + " SELECT code, aspect, mentions, base, lifecycle, severity, CAST(r AS INTEGER) AS place FROM s WHERE r <= 6")
def negative_categories(spark, sf):
    return negatives(spark, sf).where("place <= 6")


@query("a16_negative_rollup", NEGATIVE + " SELECT code, count(*) FILTER (severity = 'high') AS alerts, CAST(sum(mentions) AS BIGINT) AS mentions, CAST(sum(base) AS BIGINT) AS base FROM s WHERE r <= 6 GROUP BY 1")
def negative_rollup(spark, sf):
    return negatives(spark, sf).where("place <= 6").groupBy("code").agg(F.count_if(F.col("severity") == "high").alias("alerts"), F.sum("mentions").alias("mentions"), M.null_infectious_sum(F.col("base")).alias("base"))


STAGE_UNITS = UNITS + f", d AS (SELECT code, CAST(date_diff('day', DATE '{D14.first}', CAST(posted_at + INTERVAL 8 HOUR AS DATE)) AS INTEGER) AS i, count(*) FILTER (attitude = 'positive') AS p, count(*) FILTER (attitude = 'negative') AS n FROM u WHERE {IN14} GROUP BY 1, 2), c AS (SELECT code, i, CASE WHEN p + n < 10 THEN NULL WHEN CAST(p - n AS DOUBLE) / (p + n) > 0.12 THEN 'positive' WHEN CAST(p - n AS DOUBLE) / (p + n) < -0.12 THEN 'negative' ELSE 'neutral' END AS cat FROM d)"


@query("f8_net_tone", STAGE_UNITS + " SELECT code, i, cat FROM c")
def net_tone(spark, sf):
    return _toned(spark, sf)


def _toned(spark, sf):
    c = units(spark, sf, D14).groupBy("code", C.bucket(F.col("posted_at"), D14).alias("i")).agg(*tri())
    return c.select("code", "i", M.net_tone(F.col("positive"), F.col("negative")).alias("cat"))


@query(
    "w8_stages",
    STAGE_UNITS
    + ", f AS (SELECT *, coalesce(last_value(cat IGNORE NULLS) OVER (PARTITION BY code ORDER BY i ROWS UNBOUNDED PRECEDING), first_value(cat IGNORE NULLS) OVER (PARTITION BY code ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS k FROM c), g AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY code ORDER BY i) = 1 OR k IS DISTINCT FROM lag(k) OVER (PARTITION BY code ORDER BY i) THEN 1 ELSE 0 END AS new FROM f) SELECT code, i, cat, k AS stage_cat, CAST(sum(new) OVER (PARTITION BY code ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stage FROM g",
)
def stages_short(spark, sf):
    return T.stages(_toned(spark, sf), ["code"], 7, False).select("code", "i", "cat", "stage_cat", "stage")


@query(
    "w9_stages_long",
    STAGE_UNITS
    + ", f AS (SELECT *, coalesce(last_value(cat IGNORE NULLS) OVER (PARTITION BY code ORDER BY i ROWS UNBOUNDED PRECEDING), first_value(cat IGNORE NULLS) OVER (PARTITION BY code ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS k FROM c), g AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY code ORDER BY i) = 1 OR k IS DISTINCT FROM lag(k) OVER (PARTITION BY code ORDER BY i) THEN 1 ELSE 0 END AS new FROM f), h AS (SELECT *, sum(new) OVER (PARTITION BY code ORDER BY i ROWS UNBOUNDED PRECEDING) AS s FROM g), v AS (SELECT *, count(cat) OVER (PARTITION BY code, s) AS valid, row_number() OVER (PARTITION BY code ORDER BY i) AS rn FROM h), w AS (SELECT *, CASE WHEN rn = 1 OR (new = 1 AND valid > 1) THEN 1 ELSE 0 END AS head FROM v), x AS (SELECT *, sum(head) OVER (PARTITION BY code ORDER BY i ROWS UNBOUNDED PRECEDING) AS stage FROM w) SELECT code, i, cat, first_value(k) OVER (PARTITION BY code, stage ORDER BY i) AS stage_cat, CAST(stage AS BIGINT) AS stage FROM x",
)
def stages_long(spark, sf):
    return T.stages(_toned(spark, sf), ["code"], 14, False).select("code", "i", "cat", "stage_cat", "stage")


@query("f31_half_days", B.ctes("feeds") + " SELECT code, CAST(CASE WHEN hour(posted_at + INTERVAL 8 HOUR) < 12 THEN 0 WHEN hour(posted_at + INTERVAL 8 HOUR) < 17 THEN 1 ELSE 2 END AS INTEGER) AS period, count(*) AS posts FROM feeds GROUP BY 1, 2")
def half_days(spark, sf):
    return B.feeds(spark, sf).groupBy("code", C.half_day(F.col("posted_at")).alias("period")).agg(F.count(F.lit(1)).alias("posts"))


@query("v6_unique_routing", B.ctes("feeds", "comments") + ", r AS (SELECT DISTINCT comment_id, said_code AS code, 1 AS own FROM comments UNION SELECT comment_id, f.code, 0 FROM comments c JOIN feeds f USING (feed_id) WHERE c.k % 4 <> 0), x AS (SELECT comment_id, count(DISTINCT code) AS n, min(code) AS code FROM r GROUP BY 1) SELECT code, count(*) AS n FROM x WHERE n = 1 GROUP BY 1")
def unique_routing(spark, sf):
    c = B.comments(spark, sf)
    parent = c.where("k % 4 <> 0").join(B.feeds(spark, sf).select("feed_id", "code"), "feed_id").select("comment_id", "code")
    r = T.routes(parent, c.select("comment_id", F.col("said_code").alias("code")))
    return r.groupBy("comment_id").agg(F.count_distinct("code").alias("n"), F.min("code").alias("code")).where("n = 1").groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("v1_a36_route_audit", B.ctes("feeds", "comments") + ", p AS (SELECT DISTINCT comment_id, f.code FROM comments c JOIN feeds f USING (feed_id) WHERE c.k % 4 <> 0), o AS (SELECT DISTINCT comment_id, said_code AS code FROM comments), r AS (SELECT coalesce(p.comment_id, o.comment_id) AS comment_id, coalesce(p.code, o.code) AS code, p.code IS NOT NULL AS mp, o.code IS NOT NULL AS mc FROM p FULL JOIN o ON p.comment_id = o.comment_id AND p.code = o.code) SELECT r.code, count(*) AS routes, count(*) FILTER (mp) AS matched_parent, count(*) FILTER (mc) AS matched_comment, count(*) FILTER (r.code <> f.code) AS cross_product FROM r JOIN comments c USING (comment_id) JOIN feeds f USING (feed_id) GROUP BY 1")
def route_audit(spark, sf):
    c, f = B.comments(spark, sf), B.feeds(spark, sf).select("feed_id", F.col("code").alias("anchor"))
    parent = c.where("k % 4 <> 0").join(f, "feed_id").select("comment_id", F.col("anchor").alias("code"))
    r = T.routes(parent, c.select("comment_id", F.col("said_code").alias("code"))).join(c.select("comment_id", "feed_id").join(f, "feed_id"), "comment_id")
    return r.groupBy("code").agg(F.count(F.lit(1)).alias("routes"), F.count_if("matched_parent").alias("matched_parent"), F.count_if("matched_comment").alias("matched_comment"), F.count_if(F.col("code") != F.col("anchor")).alias("cross_product"))


@query("v27_w10_evidence_threads", UNITS + f", e AS (SELECT code, feed_id, target_id, aspect, row_number() OVER (PARTITION BY code, feed_id ORDER BY target_id) AS r, count(*) OVER (PARTITION BY code, feed_id) AS units FROM (SELECT code, feed_id, aspect, min(target_id) AS target_id FROM u WHERE attitude = 'negative' AND {IN7} GROUP BY 1, 2, 3)) SELECT code, feed_id, units, target_id, CAST(r AS INTEGER) AS place FROM e WHERE r <= 3")
def evidence_threads(spark, sf):
    rows = units(spark, sf, D7).where("attitude = 'negative'").groupBy("code", "feed_id", "aspect").agg(F.min("target_id").alias("target_id"))
    w = W.partitionBy("code", "feed_id")
    rows = rows.withColumns({"place": F.row_number().over(w.orderBy("target_id")), "units": F.count(F.lit(1)).over(w)})
    return rows.where("place <= 3").select("code", "feed_id", "units", "target_id", "place")


@query("v28_j13_competitors", CURRENT + f", n AS (SELECT code, count(*) AS posts FROM feeds WHERE {IN7} GROUP BY 1), x AS (SELECT a.code, b.code AS rival, n.posts, row_number() OVER (PARTITION BY a.code ORDER BY n.posts DESC, b.code) AS r FROM products a JOIN products b ON a.sector = b.sector AND a.code <> b.code JOIN n ON n.code = b.code WHERE n.posts > 0) SELECT code, rival, posts, CAST(r AS INTEGER) AS place FROM x WHERE r <= 3")
def competitors(spark, sf):
    p = B.products(spark, sf)
    n = B.feeds(spark, sf).where(C.in_window(F.col("posted_at"), D7)).groupBy(F.col("code").alias("rival")).agg(F.count(F.lit(1)).alias("posts"))
    pairs = p.select("code", "sector").join(p.select(F.col("code").alias("rival"), "sector"), "sector").where("code <> rival").join(n, "rival").where("posts > 0")
    return pairs.withColumn("place", F.row_number().over(W.partitionBy("code").orderBy(F.desc("posts"), "rival"))).where("place <= 3").select("code", "rival", "posts", "place")


@query("v26_risk_list", UNITS + " SELECT u.code, u.target_id, u.aspect FROM u JOIN products p ON p.code = u.code WHERE p.ownership = 'own' AND aspect IN ('aspect1','aspect5') AND (attitude = 'negative' OR market = 'bearish')")
def risk_list(spark, sf):
    own = B.products(spark, sf).where("ownership = 'own'").select("code")
    return units(spark, sf).join(own, "code", "left_semi").where("aspect in ('aspect1', 'aspect5') and (attitude = 'negative' or market = 'bearish')").select("code", "target_id", "aspect")


@query("j11_multiway_units", CURRENT + " SELECT subject_code, attitude, market, count(*) AS n, count(CASE WHEN aspect <> '' THEN 1 END) AS with_aspect FROM cur WHERE relevance = 'relevant' GROUP BY 1, 2, 3")
def multiway_units(spark, sf):
    """The EAV log as one row a kind, joined again by unit."""
    cur = T.current(B.annotations(spark, sf), KEYS)
    kinds = {k: cur.select(*KEYS, F.col(k)) for k in ("attitude", "market")}
    rows = cur.where("relevance = 'relevant'").select(*KEYS, "aspect")
    for d in kinds.values():
        rows = rows.join(d, KEYS)
    return rows.groupBy("subject_code", "attitude", "market").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("aspect") != "").alias("with_aspect"))


@query("v11_label_propagation", CURRENT + " SELECT c.comment_id, cur.attitude FROM comments c JOIN cur ON cur.target_id = c.comment_id - c.comment_id % 4 + 1 AND cur.subject_code = c.said_code LEFT JOIN cur own ON own.target_id = c.comment_id AND own.subject_code = c.said_code AND own.review_state IN ('approved','corrected') WHERE own.target_id IS NULL AND c.comment_id % 4 <> 1")
def label_propagation(spark, sf):
    """Labels of a representative go to its members, never over a human one."""
    cur = T.current(B.annotations(spark, sf), KEYS)
    members = B.comments(spark, sf).where("comment_id % 4 <> 1").select("comment_id", (F.col("comment_id") - F.col("comment_id") % 4 + 1).alias("target_id"), F.col("said_code").alias("subject_code"))
    human = cur.where(F.col("review_state").isin(*T.HUMAN)).select(F.col("target_id").alias("comment_id"), "subject_code")
    return members.join(human, ["comment_id", "subject_code"], "left_anti").join(cur.select(*KEYS, "attitude"), KEYS).select("comment_id", "attitude")


@query(
    "a12_f9_funnel",
    CURRENT + f", {JOBS}, j AS (SELECT DISTINCT target_id FROM jobs WHERE status <> 'dead'), d AS (SELECT DISTINCT target_id FROM cur), r AS (SELECT DISTINCT target_id FROM cur WHERE relevance = 'relevant') SELECT f.code, count(*) AS raw, count(CASE WHEN c.k % 9 <> 0 THEN 1 END) AS parsed, count(j.target_id) AS eligible, count(CASE WHEN j.target_id IS NOT NULL AND d.target_id IS NOT NULL THEN 1 END) AS done, count(CASE WHEN j.target_id IS NOT NULL AND r.target_id IS NOT NULL THEN 1 END) AS relevant, CASE WHEN count(j.target_id) > 0 THEN round_even(least(1.0, CAST(count(CASE WHEN j.target_id IS NOT NULL AND d.target_id IS NOT NULL THEN 1 END) AS DOUBLE) / count(j.target_id)), 4) END AS coverage FROM comments c JOIN feeds f USING (feed_id) LEFT JOIN j ON j.target_id = c.comment_id LEFT JOIN d ON d.target_id = c.comment_id LEFT JOIN r ON r.target_id = c.comment_id GROUP BY 1",
)
def funnel(spark, sf):
    cur = T.current(B.annotations(spark, sf), KEYS)
    told = cur.groupBy(F.col("target_id").alias("comment_id")).agg(F.lit(True).alias("_d"), F.bool_or(F.col("relevance") == "relevant").alias("_r"))
    open_ = jobs(spark, sf).where("status <> 'dead'").groupBy(F.col("target_id").alias("comment_id")).agg(F.lit(True).alias("_j"))
    rows = B.comments(spark, sf).join(B.feeds(spark, sf).select("feed_id", "code"), "feed_id")
    rows = rows.join(open_, "comment_id", "left").join(told, "comment_id", "left")
    out = rows.groupBy("code").agg(F.count(F.lit(1)).alias("raw"), F.count_if(F.col("k") % 9 != 0).alias("parsed"), F.count("_j").alias("eligible"), F.count_if(F.col("_j") & F.col("_d")).alias("done"), F.count_if(F.col("_j") & F.col("_r")).alias("relevant"))
    return out.withColumn("coverage", M.coverage_ratio(F.col("done"), F.col("eligible")))
