"""Queries of selection, readiness, membership, orders and limits, slots, times, checked readers."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatterscope.functions import calendar as C
from chatterscope.functions import text as X
from chatterscope.operators import prices as P
from chatterscope.operators import selection as S
from chatterscope.plans.catalog import query
from chatterscope.sources import bindings as B
from chatterscope.sources import dump as D
from chatterscope.sources import jsonl as J

BASE = B.ctes("feeds", "comments", "products", "mentions")
DAYS = [date(2024, 1, d) for d in range(1, 32)]
HOLIDAYS = (date(2024, 1, 1),)
SLOTS = "days AS (SELECT CAST(DATE '2024-01-01' + CAST(i AS INTEGER) AS DATE) AS day FROM range(31) r(i)), slots AS (SELECT day, CAST(day AS TIMESTAMP) + INTERVAL 1 MINUTE * m AS slot FROM days, (SELECT unnest([570, 600, 630, 660, 690, 780, 810, 840, 870, 900, 930]) AS m) WHERE isodow(day) < 6 AND day <> DATE '2024-01-01')"
TICKS = "ticks AS (SELECT event_type AS code, event_id, value, time_bucket(INTERVAL 30 MINUTE, ts + INTERVAL 8 HOUR) AS slot FROM events)"


def days(spark):
    return spark.createDataFrame([(d,) for d in DAYS], "day date")


def slot_bars(spark, sf):
    """Half-hour bars of an event's value, local time."""
    e = B.read(spark, sf, "events").select(F.col("event_type").alias("code"), "event_id", "value", C.local(F.col("ts")).alias("at"))
    e = e.withColumn("slot", F.date_trunc("hour", "at").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.floor(F.minute("at") / 30).cast("int") * 30))
    return e.groupBy("code", "slot").agg(F.min_by("value", "event_id").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "event_id").alias("close"))


@query("f28_session_slots", f"WITH {SLOTS} SELECT CAST(day AS VARCHAR) AS day, slot FROM slots")
def session_slots(spark, sf):
    return P.session_slots(days(spark), HOLIDAYS).select(F.col("day").cast("string").alias("day"), "slot")


@query(
    "j17_f28_session_prices",
    f"WITH {SLOTS}, {TICKS}, bars AS (SELECT code, slot, arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low, arg_max(value, event_id) AS close FROM ticks GROUP BY 1, 2),"
    " h AS (SELECT code, day, hour(slot) AS hour, arg_min(open, slot) AS open, max(high) AS high, min(low) AS low, arg_max(close, slot) AS close FROM bars JOIN slots USING (slot) GROUP BY 1, 2, 3)"
    " SELECT c.code, CAST(d.day AS VARCHAR) AS day, CAST(x.hour AS INTEGER) AS hour, open, high, low, close, CASE WHEN close IS NOT NULL THEN '' WHEN d.day NOT IN (SELECT day FROM slots) THEN 'closed' WHEN x.hour IN (9, 10, 11, 13, 14, 15) THEN 'missing' WHEN x.hour = 12 THEN 'lunch' ELSE 'outside' END AS note"
    " FROM (SELECT DISTINCT event_type AS code FROM events) c CROSS JOIN days d CROSS JOIN range(24) x(hour) LEFT JOIN h ON h.code = c.code AND h.day = d.day AND h.hour = x.hour",
)
def session_prices(spark, sf):
    codes = B.products(spark, sf).select("code")
    out = P.hour_prices(codes, days(spark), P.session_slots(days(spark), HOLIDAYS), slot_bars(spark, sf))
    return out.withColumn("day", F.col("day").cast("string"))


@query(
    "f25_future_buckets",
    BASE + ", t AS (SELECT max(posted_at) + INTERVAL 8 HOUR AS through FROM feeds), g AS (SELECT code, CAST(hour(posted_at + INTERVAL 8 HOUR) AS INTEGER) AS bucket, count(*) AS n, sum(like_count) AS likes FROM feeds WHERE CAST(posted_at + INTERVAL 8 HOUR AS DATE) = DATE '2024-01-30' GROUP BY 1, 2)"
    " SELECT products.code AS code, CAST(b.b AS INTEGER) AS bucket, CASE WHEN TIMESTAMP '2024-01-30 00:00:00' + INTERVAL 1 HOUR * b.b <= through THEN coalesce(n, 0) END AS posts, CASE WHEN TIMESTAMP '2024-01-30 00:00:00' + INTERVAL 1 HOUR * b.b <= through THEN CAST(coalesce(likes, 0) AS BIGINT) END AS likes FROM products CROSS JOIN range(24) b(b) CROSS JOIN t LEFT JOIN g ON g.code = products.code AND g.bucket = b.b",
)
def future_buckets(spark, sf):
    """The running day: an hour that begins after the last data is unknown, not zero."""
    r = C.build_range("d0", B.ANCHOR)
    feeds = B.feeds(spark, sf)
    seen = feeds.where(C.in_window(F.col("posted_at"), r)).groupBy("code", C.bucket(F.col("posted_at"), r).alias("bucket")).agg(F.count(F.lit(1)).alias("posts"), F.sum("like_count").alias("likes"))
    spine = B.products(spark, sf).select("code", F.explode(F.sequence(F.lit(0), F.lit(r.buckets - 1))).alias("bucket"))
    through = feeds.agg(C.local(F.max("posted_at")).alias("through"))
    start = F.lit(str(r.first)).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("bucket"))
    out = spine.join(seen, ["code", "bucket"], "left").na.fill(0, ["posts", "likes"]).crossJoin(F.broadcast(through))
    return out.select("code", "bucket", *[F.when(start <= F.col("through"), F.col(c)).alias(c) for c in ("posts", "likes")])


@query("f22_custom_range", BASE + " SELECT code, count(*) FILTER (posted_at >= TIMESTAMP '2024-01-09 16:00:00' AND posted_at < TIMESTAMP '2024-01-14 16:00:00') AS posts, count(*) FILTER (posted_at >= TIMESTAMP '2024-01-04 16:00:00' AND posted_at < TIMESTAMP '2024-01-09 16:00:00') AS before FROM feeds WHERE posted_at >= TIMESTAMP '2024-01-04 16:00:00' AND posted_at < TIMESTAMP '2024-01-14 16:00:00' GROUP BY 1")
def custom_range(spark, sf):
    r = C.build_range("custom:2024-01-10:2024-01-14", B.ANCHOR)
    both = C.Range(r.baseline().first, r.last)
    feeds = B.feeds(spark, sf).where(C.in_window(F.col("posted_at"), both))
    return feeds.groupBy("code").agg(F.count_if(C.in_window(F.col("posted_at"), r)).alias("posts"), F.count_if(C.in_window(F.col("posted_at"), r.baseline())).alias("before"))


@query("f26_f27_anchor", "SELECT event_type, CAST(CASE WHEN hour(t) >= 23 THEN CAST(t AS DATE) ELSE CAST(t AS DATE) - 1 END AS VARCHAR) AS anchor FROM (SELECT event_type, max(ts) + INTERVAL 8 HOUR AS t FROM events GROUP BY 1)")
def anchor(spark, sf):
    latest = B.read(spark, sf, "events").groupBy("event_type").agg(F.max("ts").alias("t"))
    return latest.select("event_type", C.anchor_of(F.col("t")).cast("date").cast("string").alias("anchor"))


WRITTEN = "CASE event_id % 7 WHEN 0 THEN CAST(epoch(date_trunc('second', ts))::BIGINT AS VARCHAR) WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 2 THEN strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S+08:00') WHEN 3 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 4 THEN '' WHEN 5 THEN '0' ELSE 'yesterday' END"


@query("f30_time_coercion", f"SELECT event_id, {WRITTEN} AS raw, CASE WHEN event_id % 7 < 4 THEN date_trunc('second', ts) END AS at FROM events")
def time_coercion(spark, sf):
    n, ts = F.col("event_id") % 7, F.col("ts")
    later = ts + F.make_dt_interval(F.lit(0), F.lit(8))
    epoch = F.unix_timestamp(F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).cast("string")
    raw = F.when(n == 0, epoch).when(n == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(n == 2, F.date_format(later, "yyyy-MM-dd'T'HH:mm:ss'+08:00'")).when(n == 3, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).when(n == 4, "").when(n == 5, "0").otherwise("yesterday")
    rows = B.read(spark, sf, "events").select("event_id", raw.alias("raw"))
    return rows.select("event_id", "raw", C.coerced_time(F.col("raw")).alias("at"))


@query("p16_product_selection", BASE + " SELECT code, ownership, sector FROM products WHERE ownership = 'own' AND sector IN ('traffic', 'money') AND struct = 'long'")
def product_selection(spark, sf):
    return S.select_products(B.products(spark, sf), {"ownership": ["own"], "sector": [" traffic", "money"], "struct": ["long"], "code": None}).select("code", "ownership", "sector")


@query("p9_readiness_gate", "SELECT (SELECT count(DISTINCT r_name) FROM region WHERE (r_name = 'ASIA' AND CAST(r_regionkey AS VARCHAR) = '2') OR (r_name = 'EUROPE' AND CAST(r_regionkey AS VARCHAR) = '3')) = 2 AS ready, (SELECT count(*) FROM nation) AS guarded")
def readiness_gate(spark, sf):
    """What stands behind the gate is told only if it is open."""
    gate = S.ready(B.read(spark, sf, "region").select(F.col("r_name").alias("k"), F.col("r_regionkey").cast("string").alias("v")), {"ASIA": "2", "EUROPE": "3"})
    held = B.read(spark, sf, "nation").agg(F.count(F.lit(1)).alias("n"))
    return gate.crossJoin(held).select("ready", F.when(F.col("ready"), F.col("n")).alias("guarded"))


ROUTES = "routes AS (SELECT comment_id, said_code AS subject_code, CASE WHEN k % 3 = 0 THEN 'v1' ELSE 'v2' END AS rule_version FROM comments WHERE k % 4 <> 0)"


@query("p8_route_exists", BASE + f", {ROUTES} SELECT comment_id, said_code AS subject_code FROM comments c WHERE EXISTS (SELECT 1 FROM routes r WHERE r.comment_id = c.comment_id AND r.subject_code = c.said_code AND r.rule_version = 'v2')")
def route_exists(spark, sf):
    c = B.comments(spark, sf)
    routes = c.where("k % 4 <> 0").select("comment_id", F.col("said_code").alias("subject_code"), F.when(F.col("k") % 3 == 0, "v1").otherwise("v2").alias("rule_version"))
    return S.has_route(c.select("comment_id", F.col("said_code").alias("subject_code")), routes, "v2")


TARGETS = "j AS (SELECT event_id AS job_id, CASE WHEN event_id % 4 = 0 THEN 'feed' ELSE 'comment' END AS target_type, event_id AS target_id, CASE WHEN event_id % 5 = 0 THEN event_id % 3 END AS scope_id FROM events)"


def target_jobs(spark, sf):
    i = F.col("event_id")
    return B.read(spark, sf, "events").select(i.alias("job_id"), F.when(i % 4 == 0, "feed").otherwise("comment").alias("target_type"), i.alias("target_id"), F.when(i % 5 == 0, i % 3).alias("scope_id"))


@query("j5_target_post", BASE + f", {TARGETS} SELECT j.job_id, f.feed_id, f.code FROM j LEFT JOIN comments c ON j.target_type = 'comment' AND c.comment_id = j.target_id LEFT JOIN feeds f ON f.feed_id = CASE WHEN j.target_type = 'comment' THEN c.feed_id ELSE j.target_id END")
def target_post(spark, sf):
    feeds = B.feeds(spark, sf).select("feed_id", "code")
    out = S.with_target_post(target_jobs(spark, sf), B.comments(spark, sf).select("comment_id", "feed_id"), feeds)
    return out.select("job_id", F.when(F.col("code").isNotNull(), F.col("feed_id")).alias("feed_id"), "code")


@query("j22_scope_membership", f"WITH {TARGETS}, b AS (SELECT event_id AS job_id, event_id % 4 AS scope_id FROM events WHERE event_id % 3 = 0) SELECT job_id, target_type FROM j WHERE scope_id = 2 OR EXISTS (SELECT 1 FROM b WHERE b.scope_id = 2 AND b.job_id = j.job_id)")
def scope_membership(spark, sf):
    bridge = B.read(spark, sf, "events").where("event_id % 3 = 0").select(F.col("event_id").alias("job_id"), (F.col("event_id") % 4).alias("scope_id"))
    return S.in_scope(target_jobs(spark, sf), bridge, 2).select("job_id", "target_type")


@query("j10_counts_lookup", BASE + " SELECT f.feed_id, coalesce(n, 0) AS replies, coalesce(likes, 0) AS likes FROM feeds f LEFT JOIN (SELECT feed_id, count(*) AS n, CAST(coalesce(sum(like_count), 0) AS BIGINT) AS likes FROM comments GROUP BY 1) USING (feed_id)")
def counts_lookup(spark, sf):
    c = B.comments(spark, sf).groupBy("feed_id").agg(F.count(F.lit(1)).alias("replies"), F.coalesce(F.sum("like_count"), F.lit(0)).alias("likes"))
    return B.feeds(spark, sf).select("feed_id").join(c, "feed_id", "left").na.fill(0, ["replies", "likes"])


@query("p14_in_list", BASE + " SELECT feed_id, code FROM feeds WHERE feed_id IN (SELECT feed_id FROM comments WHERE like_count >= 10)")
def in_list(spark, sf):
    """A list of any length is a semi join, never chunks of literals."""
    return B.feeds(spark, sf).select("feed_id", "code").join(B.comments(spark, sf).where("like_count >= 10").select("feed_id"), "feed_id", "left_semi")


@query("p13_contract_projection", BASE + " SELECT feed_id AS id, code, like_count AS likes, share_count AS shares, CAST(NULL AS BIGINT) AS follows FROM feeds")
def contract_projection(spark, sf):
    """The contract's keys in its order: one the source lacks is there as null."""
    have = {"id": "feed_id", "code": "code", "likes": "like_count", "shares": "share_count"}
    return B.feeds(spark, sf).select(*[F.col(have[k]).alias(k) if k in have else F.lit(None).cast("long").alias(k) for k in ("id", "code", "likes", "shares", "follows")])


@query("l1_newest_first", BASE + " SELECT feed_id, posted_at FROM feeds ORDER BY posted_at DESC, feed_id DESC LIMIT 50")
def newest_first(spark, sf):
    return B.feeds(spark, sf).select("feed_id", "posted_at").orderBy(F.desc("posted_at"), F.desc("feed_id")).limit(50)


@query("l2_clamped_evidence", BASE + " SELECT comment_id, like_count FROM comments ORDER BY like_count DESC NULLS LAST, comment_id LIMIT 12")
def clamped_evidence(spark, sf):
    return B.comments(spark, sf).select("comment_id", "like_count").orderBy(*S.unknown_last("like_count", descending=True), "comment_id").limit(S.clamped(99, 1, 12, 6))


@query("l3_clamped_runs", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def clamped_runs(spark, sf):
    return B.read(spark, sf, "events").orderBy(F.desc("ts"), F.desc("event_id")).select("event_id").limit(S.clamped(None, 1, 500, 200))


@query("l7_w13_stable_order", "SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY x IS NULL, x DESC, p_name, p_partkey) AS INTEGER) AS place FROM (SELECT *, CASE WHEN p_size % 7 <> 0 THEN p_size END AS x FROM part)")
def stable_order(spark, sf):
    from pyspark.sql import Window as W

    rows = B.read(spark, sf, "part").withColumn("x", F.when(F.col("p_size") % 7 != 0, F.col("p_size")))
    place = F.row_number().over(W.partitionBy("p_brand").orderBy(*S.unknown_last("x", descending=True), "p_name", "p_partkey"))
    return rows.select("p_partkey", place.alias("place"))


@query("f74_first_wins", "SELECT doc_id, md5(string_agg(w, ' ' ORDER BY p)) AS words, count(*) AS n FROM (SELECT doc_id, w, min(p) AS p FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS p FROM documents) GROUP BY 1, 2) GROUP BY 1")
def first_wins(spark, sf):
    w = S.first_wins(F.split("text", " "))
    return B.read(spark, sf, "documents").select("doc_id", F.md5(F.array_join(w, " ")).alias("words"), F.size(w).cast("long").alias("n"))


EAV = "CASE event_id % 5 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN '\"' || event_type || '\"' WHEN 2 THEN 'true' WHEN 3 THEN 'null' ELSE '{broken' END"


@query("f75_value_decode", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_id END AS number, CASE event_id % 5 WHEN 1 THEN event_type END AS text, CASE event_id % 5 WHEN 2 THEN true END AS flag, event_id % 5 = 4 AS broken FROM events")
def value_decode(spark, sf):
    """One JSON value a row, of whatever type: null is a value, what does not parse is broken."""
    i = F.col("event_id")
    raw = F.when(i % 5 == 0, i.cast("string")).when(i % 5 == 1, F.concat(F.lit('"'), "event_type", F.lit('"'))).when(i % 5 == 2, "true").when(i % 5 == 3, "null").otherwise("{broken")
    v = F.try_parse_json(raw)
    kind = F.schema_of_variant(v)
    rows = B.read(spark, sf, "events").select("event_id", v.alias("v"), kind.alias("kind"))
    as_ = lambda name, t: F.when(F.col("kind") == name, F.try_variant_get("v", "$", t))
    return rows.select("event_id", as_("BIGINT", "bigint").alias("number"), as_("STRING", "string").alias("text"), as_("BOOLEAN", "boolean").alias("flag"), F.col("v").isNull().alias("broken"))


GENERATIONS = "g AS (SELECT c_custkey, c_mktsegment, CASE WHEN o_orderdate IS NULL THEN NULL WHEN c_custkey % 11 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') || '|' ELSE strftime(o_orderdate, '%Y-%m-%d') || '|' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 8) END AS generation, c_custkey % 5 = 0 AS dirty FROM customer LEFT JOIN (SELECT o_custkey, CASE WHEN max(o_orderdate) > TIMESTAMP '2001-01-01' THEN TIMESTAMP '2001-01-01' ELSE max(o_orderdate) END + CASE WHEN o_custkey % 13 = 0 THEN INTERVAL 400 DAY ELSE INTERVAL 0 DAY END AS o_orderdate FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey)"


@query("a33_layer_states", f"WITH {GENERATIONS} SELECT c_mktsegment AS kind, CASE WHEN generation IS NULL OR split_part(generation, '|', 2) = '' OR split_part(generation, '|', 1) > '2001-01-01' THEN 'missing' WHEN split_part(generation, '|', 1) = '2001-01-01' AND NOT dirty THEN 'fresh' ELSE 'stale' END AS state, count(*) AS products FROM g GROUP BY 1, 2")
def layer_states(spark, sf):
    last = B.read(spark, sf, "orders").groupBy("o_custkey").agg(F.least(F.max("o_orderdate"), F.lit("2001-01-01 00:00:00").cast("timestamp_ntz")).alias("d"))
    last = last.withColumn("d", F.when(F.col("o_custkey") % 13 == 0, F.date_add(F.col("d").cast("date"), 400)).otherwise(F.col("d").cast("date")))
    c = B.read(spark, sf, "customer").join(last, F.col("o_custkey") == F.col("c_custkey"), "left")
    print_ = F.when(F.col("c_custkey") % 11 == 0, "").otherwise(F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 8))
    rows = c.select(F.col("c_mktsegment").alias("kind"), F.concat(F.col("d").cast("string"), F.lit("|"), print_).alias("generation"), (F.col("c_custkey") % 5 == 0).alias("dirty"))
    return S.layer_states(rows, "2001-01-01").groupBy("kind", "state").agg(F.count(F.lit(1)).alias("products"))


@query("a31_codes_with_output", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS codes FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def codes_with_output(spark, sf):
    return B.read(spark, sf, "orders").where("o_orderstatus = 'F'").groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("codes"))


@query("a39_progress_summary", "WITH p AS (SELECT o_custkey, bool_and(o_orderstatus = 'F') AS complete FROM orders GROUP BY 1), s AS (SELECT count(*) FILTER (complete) AS done, count(*) AS total FROM p), g AS (SELECT count(*) AS gap FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM p)) SELECT done, CASE WHEN gap > 0 THEN (SELECT count(*) FROM customer) ELSE total END AS total, gap, CASE WHEN gap > 0 THEN 'source_changed' WHEN done = total THEN 'complete' ELSE 'running' END AS status FROM s, g")
def progress_summary(spark, sf):
    """Done and total of the products under way; one that the catalog has and the run has not makes the run outdated."""
    p = B.read(spark, sf, "orders").groupBy("o_custkey").agg(F.bool_and(F.col("o_orderstatus") == "F").alias("complete"))
    c = B.read(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"))
    s = p.agg(F.count_if("complete").alias("done"), F.count(F.lit(1)).alias("known")).crossJoin(c.join(p, "o_custkey", "left_anti").agg(F.count(F.lit(1)).alias("gap"))).crossJoin(c.agg(F.count(F.lit(1)).alias("_all")))
    gone = F.col("gap") > 0
    return s.select("done", F.when(gone, F.col("_all")).otherwise(F.col("known")).alias("total"), "gap", F.when(gone, "source_changed").when(F.col("done") == F.col("known"), "complete").otherwise("running").alias("status"))


#: Terms by class: entity, action and rumor words.
LEXICON = {
    "claims": ("entity_or_action", ("bank", "agency"), ("sue", "fine"), ()),
    "abuse": ("action", (), ("scam", "idiot", "worthless"), ()),
    "closing": ("entity_and_rumor", ("fund", "tion"), (), ("heard", "guarantee")),
}


def _any_sql(words):
    return "(" + " OR ".join(f"contains(low, '{w}')" for w in words) + ")" if words else "false"


def _mode_sql(mode, entity, action, rumor):
    return {"entity_or_action": f"({_any_sql(entity)} OR {_any_sql(action)})", "action": _any_sql(action), "entity_and_rumor": f"({_any_sql(entity)} AND {_any_sql(rumor)})"}[mode]


@query("f55_lexicon_modes", "WITH t AS (SELECT doc_id, lower(text) AS low FROM documents) SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN {_mode_sql(*spec)} THEN '{tag}' END" for tag, spec in LEXICON.items()) + ") AS tags FROM t")
def lexicon_modes(spark, sf):
    return B.read(spark, sf, "documents").select("doc_id", F.array_join(X.lexicon_tags(F.col("text"), LEXICON), ",").alias("tags"))


@query("v9_offpool_rule", "SELECT doc_id, CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9])(anly|tion|hend)([^a-z0-9]|$)') AND NOT contains(lower(text), 'fund') AND NOT contains(lower(text), 'wing') THEN 'offpool_stock_only' END AS rule FROM documents")
def offpool_rule(spark, sf):
    """The cascade's last rule: a text that names stocks outside the pool and nothing of the product."""
    rows = B.read(spark, sf, "documents").select("doc_id", "text")
    return X.offpool_only(rows, "text", stocks=("anly", "tion", "hend"), product=("fund", "wing")).select("doc_id", "rule")


WIDE = "translate(CAST(page_id AS VARCHAR), '0123456789', '０１２３４５６７８９') || 'ＡＢ' || chr(160) || '國債㈱ｶﾞ' || url"


@query("f45_folded_forms", "SELECT page_id, CAST(page_id AS VARCHAR) || 'ab 国债(株)ガ' || lower(url) AS folded FROM pages")
def folded_forms(spark, sf):
    """Full-width and compatibility forms, capitals and traditional characters fold to one form."""
    wide = F.concat(F.translate(F.col("page_id").cast("string"), "0123456789", "０１２３４５６７８９"), F.lit("ＡＢ\xa0國債㈱ｶﾞ"), "url")
    return B.read(spark, sf, "pages").select("page_id", X.attribution_form(wide).alias("folded"))


@query("f60_product_classes", "SELECT p_partkey, CASE WHEN p_type LIKE '%TIN%' THEN 'fi' WHEN p_type LIKE '%COPPER%' THEN 'cm' WHEN p_brand LIKE '%1' THEN 'hk' ELSE 'apac' END AS sector, CASE WHEN p_type LIKE 'ECONOMY%' THEN '杠杆反向' WHEN p_type LIKE 'PROMO%' THEN '主动 ETF' ELSE 'ETF' END AS struct, CASE WHEN p_type LIKE 'ECONOMY%' THEN 'inverse' ELSE 'plain' END AS direction FROM part")
def product_classes(spark, sf):
    """Exchange wording to sector, structure and direction; the driver's types stand for asset class, focus and style."""
    t = F.col("p_type")
    rows = B.read(spark, sf, "part").select(
        "p_partkey", F.when(t.contains("TIN"), "Fixed Income").when(t.contains("COPPER"), "商品").otherwise("Equity").alias("asset_class"), F.when(F.col("p_brand").endswith("1"), "Hong Kong").otherwise("World").alias("focus"),
        F.when(t.startswith("ECONOMY"), "Inverse product").when(t.startswith("PROMO"), "Active").otherwise("Index").alias("style"),
    )
    return rows.select("p_partkey", X.sector_of(F.col("asset_class"), F.col("focus")).alias("sector"), X.struct_of(F.col("style")).alias("struct"), X.direction_of(F.col("style")).alias("direction"))


@query("s8_checked_jsonl", "SELECT event_id, event_type, CAST(user_id AS BIGINT) AS user_id, value FROM events")
def checked_jsonl(spark, sf):
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("user_id", T.LongType()), T.StructField("value", T.DoubleType())])
    lines = B.read(spark, sf, "events").select(F.to_json(F.struct("event_id", "event_type", "user_id", "value")).alias("value"))
    return J.checked(lines, schema, required=("event_type",), positive=(), counters=("event_id", "user_id"))


@query("s1_dump_rows", "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name || '''s 50\\% ' || chr(10) || '(a, b)' AS name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS segment FROM customer WHERE c_custkey % 7 <> 0")
def dump_rows(spark, sf):
    c = B.read(spark, sf, "customer")
    row = F.concat(F.lit("("), F.col("c_custkey").cast("string"), F.lit(",'"), "c_name", F.lit("\\'s 50\\% \\n(a, b)',"), F.when(F.col("c_custkey") % 3 == 0, "NULL").otherwise(F.concat(F.lit("'"), "c_mktsegment", F.lit("'"))), F.lit(")"))
    other = F.when(F.col("c_custkey") % 7 == 0, "INSERT INTO `others` VALUES ").otherwise("INSERT INTO `customers` VALUES ")
    return D.dump_rows(c.select(F.concat(other, row, F.lit(";")).alias("value")), "customers", ["id", "name", "segment"])


@query("s2_two_pass_import", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))")
def two_pass_import(spark, sf):
    stocks = B.read(spark, sf, "customer").select(F.col("c_custkey").alias("stock_id"), F.col("c_mktsegment").alias("code"))
    posts = B.read(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("stock_id"), F.col("o_orderdate").alias("posted_at"))
    return D.import_posts(posts, stocks, ["BUILDING", "MACHINERY"], "1998-01-01").select("o_orderkey")


@query("t18_dry_run", BASE + ", o AS (SELECT feed_id, code, like_count AS likes FROM feeds WHERE k % 3 <> 0), n AS (SELECT feed_id, code, like_count + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS likes FROM feeds WHERE k % 4 <> 0) SELECT CASE WHEN o.feed_id IS NULL THEN 'added' WHEN n.feed_id IS NULL THEN 'removed' WHEN o.code = n.code AND o.likes = n.likes THEN 'same' ELSE 'changed' END AS change, count(*) AS n FROM o FULL JOIN n USING (feed_id) GROUP BY 1")
def dry_run(spark, sf):
    f = B.feeds(spark, sf)
    old = f.where("k % 3 <> 0").select("feed_id", "code", F.col("like_count").alias("likes"))
    new = f.where("k % 4 <> 0").select("feed_id", "code", (F.col("like_count") + F.when(F.col("k") % 5 == 0, 1).otherwise(0)).alias("likes"))
    return S.dry_run(old, new, "feed_id")


@query("t1_source_streams", "SELECT 'feeds' AS stream, count(*) AS n, max(ts) AS cursor_at FROM events WHERE event_id % 4 = 0 UNION ALL SELECT 'details', count(*), max(ts) FROM events WHERE event_id % 4 <> 0 UNION ALL SELECT 'users', count(*), max(o_orderdate) FROM orders")
def source_streams(spark, sf):
    """Three streams with a cursor each."""
    e = B.read(spark, sf, "events")
    named = [("feeds", e.where("event_id % 4 = 0"), "ts"), ("details", e.where("event_id % 4 <> 0"), "ts"), ("users", B.read(spark, sf, "orders"), "o_orderdate")]
    out = [df.agg(F.lit(n).alias("stream"), F.count(F.lit(1)).alias("n"), F.max(c).alias("cursor_at")) for n, df, c in named]
    return out[0].unionByName(out[1]).unionByName(out[2])
