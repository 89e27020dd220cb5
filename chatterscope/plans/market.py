"""Market queries: observations, ranks, deltas, series, qualification, prices."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chatterscope.functions import calendar as C
from chatterscope.functions import metrics as M
from chatterscope.operators import observations as O
from chatterscope.operators import prices as P
from chatterscope.plans.catalog import query
from chatterscope.sources import bindings as B

D1, D7, D14 = (C.build_range(k, B.ANCHOR) for k in ("d1", "d7", "d14"))


def window_sql(r: C.Range, column: str = "posted_at") -> str:
    lo, hi = C.utc_bounds(r)
    return f"{column} >= TIMESTAMP '{lo}' AND {column} < TIMESTAMP '{hi}'"


def bucket_sql(r: C.Range, column: str = "posted_at") -> str:
    here = f"({column} + INTERVAL 8 HOUR)"
    days = f"date_diff('day', DATE '{r.first}', CAST({here} AS DATE))"
    if r.grain == "hour":
        return f"CAST({days} * 24 + hour({here}) AS INTEGER)"
    return f"CAST({days} AS INTEGER)" if r.grain == "day" else f"CAST(floor({days} / 7) AS INTEGER)"


QUALIFIED = """q AS (SELECT f.* FROM feeds f WHERE upper(source_ticker) = upper('0' || code || '.HK') AND (EXISTS (SELECT 1 FROM mentions m WHERE m.feed_id = f.feed_id AND upper(m.raw_ticker) = upper('0' || f.code || '.HK'))
 OR (f.code <> 'error' AND NOT EXISTS (SELECT 1 FROM mentions m WHERE m.feed_id = f.feed_id AND upper(m.raw_ticker) = '09999.HK'))))"""
BASE = B.ctes("feeds", "comments", "products", "mentions") + ", " + QUALIFIED
HEAT = "CAST(floor((mentions * 10 + likes * 3 + shares * 10 + 5) / 10.0) AS BIGINT)"


def observed_sql(where: str, keys: str, name: str) -> str:
    using = " AND ".join(f"o.{k.strip()} = a.{k.strip()}" for k in keys.split(","))
    return f"""{name}_p AS (SELECT q.*, {bucket_sql(D7)} AS b7, {bucket_sql(D1)} AS b1 FROM q WHERE {where}),
 {name}_r AS (SELECT feed_id, coalesce(sum(like_count), 0) AS rl FROM comments GROUP BY 1),
 {name}_o AS (SELECT {keys}, count(*) AS mentions, sum(comment_count) AS platform_comments, coalesce(sum(like_count), 0) + coalesce(sum(rl), 0) AS likes, coalesce(sum(share_count), 0) AS shares,
 count(*) - count(share_count) AS unknown_posts FROM {name}_p LEFT JOIN {name}_r USING (feed_id) GROUP BY {keys}),
 {name}_a AS (SELECT {keys}, count(DISTINCT author_uid) AS active FROM (SELECT {keys}, author_uid FROM {name}_p UNION ALL SELECT {", ".join("p." + k.strip() for k in keys.split(","))}, c.author_uid FROM {name}_p p JOIN comments c USING (feed_id)) WHERE author_uid <> '' GROUP BY {keys}),
 {name} AS (SELECT o.*, coalesce(active, 0) AS active, {HEAT} AS heat, likes + shares AS interactions FROM {name}_o o LEFT JOIN {name}_a a ON {using})"""


def posts(spark, sf, r):
    feeds = B.feeds(spark, sf).where(C.in_window(F.col("posted_at"), r))
    return O.qualified(feeds, B.mentions(spark, sf), {"error": "exact"})


def observed(spark, sf, r, keys=("code",)):
    return O.observe(posts(spark, sf, r).withColumn("bucket", C.bucket(F.col("posted_at"), r)), B.comments(spark, sf), list(keys))


CASTED = ", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ["mentions", "platform_comments", "likes", "shares", "unknown_posts", "active", "interactions", "heat"])


@query("a2_a3_a4_product_observation", f"{BASE}, {observed_sql(window_sql(D7), 'code', 'o7')} SELECT code, {CASTED} FROM products LEFT JOIN o7 USING (code)")
def product_observation(spark, sf):
    out = O.zero_filled(B.products(spark, sf).select("code"), observed(spark, sf, D7), ["code"])
    return out.drop("comments")


@query(
    "a1_j16_hour_buckets",
    f"{BASE}, {observed_sql(window_sql(D1), 'code, b1', 'o1')}, spine AS (SELECT code, CAST(i AS INTEGER) AS bucket FROM products, range(24) t(i)) SELECT s.code, s.bucket, {CASTED} FROM spine s LEFT JOIN o1 ON o1.code = s.code AND o1.b1 = s.bucket",
)
def hour_buckets(spark, sf):
    spine = B.products(spark, sf).select("code", F.explode(F.sequence(F.lit(0), F.lit(D1.buckets - 1))).alias("bucket"))
    return O.zero_filled(spine, observed(spark, sf, D1, ("code", "bucket")), ["code", "bucket"]).drop("comments")


@query("a1_day_buckets", f"{BASE}, {observed_sql(window_sql(D7), 'code, b7', 'o7')} SELECT code, b7 AS bucket, {CASTED} FROM o7")
def day_buckets(spark, sf):
    return observed(spark, sf, D7, ("code", "bucket")).drop("comments")


RANKING = f"""{BASE}, {observed_sql(window_sql(D7), 'code', 'cur')}, {observed_sql(window_sql(D7.baseline()), 'code', 'old')},
 both_ AS (SELECT p.code, p.ownership, CAST(coalesce(c.mentions, 0) AS BIGINT) AS mentions, CAST(coalesce(c.heat, 0) AS BIGINT) AS heat, CAST(coalesce(o.mentions, 0) AS BIGINT) AS base_mentions, CAST(coalesce(o.heat, 0) AS BIGINT) AS base_heat
 FROM products p LEFT JOIN cur c USING (code) LEFT JOIN old o USING (code))"""


def _both(spark, sf):
    """The window and its baseline side by side, observed in one pass over both; products without posts have zeros."""
    base = D7.baseline()
    rows = posts(spark, sf, C.Range(base.first, D7.last)).withColumn("period", F.when(C.in_window(F.col("posted_at"), D7), "cur").otherwise("base"))
    seen = O.side_by_side(O.observe(rows, B.comments(spark, sf), ["code", "period"]), "code", "period", ["mentions", "heat"])
    out = B.products(spark, sf).select("code", "ownership").join(seen, "code", "left")
    return out.na.fill(0, ["mentions", "heat", "base_mentions", "base_heat"])


def _current(spark, sf):
    return O.zero_filled(B.products(spark, sf).select("code", "ownership"), observed(spark, sf, D7), ["code"]).select("code", "ownership", "mentions", "heat")


@query(
    "market_ranking",
    RANKING
    + """ SELECT code, ownership, mentions, heat, base_mentions, base_heat, CAST(CASE WHEN base_mentions = 0 AND mentions <= 0 THEN 0 ELSE mentions - base_mentions END AS BIGINT) AS mentions_abs, CASE WHEN base_mentions <> 0 THEN round(CAST(mentions - base_mentions AS DOUBLE) / base_mentions * 100, 6) END AS mentions_pct, CAST(sign(mentions - base_mentions) AS INTEGER) AS mentions_dir,
 CAST(CASE WHEN base_heat = 0 AND heat <= 0 THEN 0 ELSE heat - base_heat END AS BIGINT) AS heat_abs, CASE WHEN base_heat <> 0 THEN round(CAST(heat - base_heat AS DOUBLE) / base_heat * 100, 6) END AS heat_pct, CAST(sign(heat - base_heat) AS INTEGER) AS heat_dir, CAST(row_number() OVER (ORDER BY mentions DESC, code) AS INTEGER) AS rank FROM both_""",
)
def market_ranking(spark, sf):
    """W1 W4 J14: the flagship."""
    return O.ranked(O.deltas(_both(spark, sf), ["mentions", "heat"]), "mentions")


@query("w2_top_products", RANKING + " SELECT code, mentions, rank FROM (SELECT code, mentions, CAST(row_number() OVER (ORDER BY mentions DESC, code) AS INTEGER) AS rank FROM both_) WHERE rank <= 3")
def top_products(spark, sf):
    return O.ranked(_current(spark, sf), "mentions").where("rank <= 3").select("code", "mentions", "rank")


@query(
    "w3_analysis_set",
    RANKING
    + " SELECT code, ownership, mentions, CAST(row_number() OVER (ORDER BY CASE WHEN ownership = 'own' THEN 0 ELSE 1 END, r) AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY ownership ORDER BY mentions DESC, code) AS r FROM both_) WHERE ownership = 'peer' OR r <= 2",
)
def analysis_set(spark, sf):
    rows = _current(spark, sf).withColumn("_r", F.row_number().over(W.partitionBy("ownership").orderBy(F.desc("mentions"), "code"))).where("ownership = 'peer' or _r <= 2")
    return rows.withColumn("place", F.row_number().over(W.orderBy(F.when(F.col("ownership") == "own", 0).otherwise(1), "_r"))).select("code", "ownership", "mentions", "place")


@query(
    "w11_growth_leaders",
    RANKING
    + " SELECT code, ownership, pct, CAST(r AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY ownership ORDER BY pct DESC, code) AS r FROM (SELECT code, ownership, round(CAST(mentions - base_mentions AS DOUBLE) / base_mentions * 100, 6) AS pct FROM both_ WHERE base_mentions >= 5) WHERE pct > 0) WHERE r <= 3",
)
def growth_leaders(spark, sf):
    rows = _both(spark, sf).where("base_mentions >= 5")
    rows = rows.withColumn("pct", F.round(M.delta_pct(F.col("mentions"), F.col("base_mentions")), 6)).where("pct > 0")
    return rows.withColumn("place", F.row_number().over(W.partitionBy("ownership").orderBy(F.desc("pct"), "code"))).where("place <= 3").select("code", "ownership", "pct", "place")


@query(
    "w12_head_and_rest",
    RANKING
    + " SELECT item, CAST(sum(heat) AS BIGINT) AS heat, count(*) AS members FROM (SELECT CASE WHEN heat > 0 AND row_number() OVER (ORDER BY heat DESC, code) <= 3 THEN code ELSE 'other' END AS item, heat FROM both_) GROUP BY 1",
)
def head_and_rest(spark, sf):
    return O.head_and_rest(_current(spark, sf).select("code", "heat"), "heat", 3)


@query("f2_delta_texts", RANKING + " SELECT code, CASE WHEN base_mentions = 0 THEN CASE WHEN mentions > 0 THEN 'new' ELSE '-' END ELSE (CASE WHEN mentions >= base_mentions THEN '+' WHEN round((mentions - base_mentions) * 100.0 / base_mentions, 0) = 0 THEN '-' ELSE '' END) || CAST(CAST(round((mentions - base_mentions) * 100.0 / base_mentions, 0) AS BIGINT) AS VARCHAR) || '%' END AS short FROM both_")
def delta_texts(spark, sf):
    return _both(spark, sf).select("code", M.delta_short(F.col("mentions"), F.col("base_mentions")).alias("short"))


@query("w14_peak_bucket", f"{BASE}, {observed_sql(window_sql(D7), 'code, b7', 'o7')} SELECT code, b7 AS peak, CAST(heat AS BIGINT) AS heat FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY heat DESC, b7) AS r FROM o7) WHERE r = 1")
def peak_bucket(spark, sf):
    return observed(spark, sf, D7, ("code", "bucket")).groupBy("code").agg(F.max_by("bucket", F.struct("heat", -F.col("bucket"))).alias("peak"), F.max("heat").alias("heat"))


@query("f10_hue_steps", f"{BASE}, {observed_sql(window_sql(D7), 'code', 'o7')} SELECT code, CAST(CASE WHEN heat <= 0 THEN 0 ELSE greatest(1, least(5, ceil(CAST(heat AS DOUBLE) / max(heat) OVER () * 5))) END AS INTEGER) AS step FROM o7")
def hue_steps(spark, sf):
    rows = observed(spark, sf, D7)
    return rows.crossJoin(F.broadcast(rows.agg(F.max("heat").alias("peak")))).select("code", M.hue_step(F.col("heat"), F.col("peak")).alias("step"))


@query(
    "a19_daily_series",
    f"""{BASE}, spine AS (SELECT code, CAST(DATE '{B.ANCHOR}' - CAST(41 - i AS INTEGER) AS DATE) AS day FROM products, range(42) t(i)),
 d AS (SELECT code, CAST(posted_at + INTERVAL 8 HOUR AS DATE) AS day, count(*) AS n, count(DISTINCT author_uid) AS authors FROM q WHERE {window_sql(C.Range(B.ANCHOR - timedelta(days=41), B.ANCHOR))} GROUP BY 1, 2)
 SELECT s.code, CAST(s.day AS VARCHAR) AS day, CAST(coalesce(n, 0) AS BIGINT) AS posts, CAST(coalesce(authors, 0) AS BIGINT) AS authors FROM spine s LEFT JOIN d USING (code, day)""",
)
def daily_series(spark, sf):
    r = C.Range(B.ANCHOR - timedelta(days=41), B.ANCHOR)
    days = posts(spark, sf, r).groupBy("code", C.local_day(F.col("posted_at")).alias("day")).agg(F.count(F.lit(1)).alias("posts"), F.count_distinct("author_uid").alias("authors"))
    spine = B.products(spark, sf).select("code", F.explode(F.sequence(F.lit(r.first), F.lit(r.last))).alias("day"))
    out = spine.join(days, ["code", "day"], "left")
    return out.select("code", F.col("day").cast("string").alias("day"), F.coalesce("posts", F.lit(0)).alias("posts"), F.coalesce("authors", F.lit(0)).alias("authors"))


@query("j15_bucket_positions", f"{BASE}, {observed_sql(window_sql(D7), 'code, b7', 'cur')}, old AS (SELECT code, {bucket_sql(D7.baseline())} AS b, count(*) AS n FROM q WHERE {window_sql(D7.baseline())} GROUP BY 1, 2) SELECT c.code, c.b7 AS bucket, c.mentions, old.n AS base_mentions FROM cur c LEFT JOIN old ON old.code = c.code AND old.b = c.b7")
def bucket_positions(spark, sf):
    base = posts(spark, sf, D7.baseline()).groupBy("code", C.bucket(F.col("posted_at"), D7.baseline()).alias("bucket")).agg(F.count(F.lit(1)).alias("base_mentions"))
    return observed(spark, sf, D7, ("code", "bucket")).select("code", "bucket", "mentions").join(base, ["code", "bucket"], "left")


@query("p4_qualified_exact", B.ctes("feeds", "mentions") + " SELECT code, count(*) AS posts, CAST(sum(like_count) AS BIGINT) AS likes FROM feeds f WHERE upper(source_ticker) = upper('0' || code || '.HK') AND EXISTS (SELECT 1 FROM mentions m WHERE m.feed_id = f.feed_id AND upper(m.raw_ticker) = upper('0' || f.code || '.HK')) GROUP BY 1")
def qualified_exact(spark, sf):
    return O.qualified_by_semi_joins(B.feeds(spark, sf), B.mentions(spark, sf), exact=True).groupBy("code").agg(F.count(F.lit(1)).alias("posts"), F.sum("like_count").alias("likes"))


@query("p5_qualified_exclude", B.ctes("feeds", "mentions") + " SELECT code, count(*) AS posts FROM feeds f WHERE upper(source_ticker) = upper('0' || code || '.HK') AND (EXISTS (SELECT 1 FROM mentions m WHERE m.feed_id = f.feed_id AND upper(m.raw_ticker) = upper('0' || f.code || '.HK')) OR NOT EXISTS (SELECT 1 FROM mentions m WHERE m.feed_id = f.feed_id AND upper(m.raw_ticker) = '09999.HK')) GROUP BY 1")
def qualified_exclude(spark, sf):
    return O.qualified_by_semi_joins(B.feeds(spark, sf), B.mentions(spark, sf), exact=False).groupBy("code").agg(F.count(F.lit(1)).alias("posts"))


@query("p6_policy_union", BASE + " SELECT code, count(*) AS posts FROM q GROUP BY 1")
def policy_union(spark, sf):
    return O.qualified(B.feeds(spark, sf), B.mentions(spark, sf), {"error": "exact"}).groupBy("code").agg(F.count(F.lit(1)).alias("posts"))


@query("p10_window_unresolved", B.ctes("feeds") + f" SELECT code, bool_or(NOT coalesce(upper(source_ticker) = upper('0' || code || '.HK'), false)) AS unresolved FROM feeds WHERE {window_sql(D1)} GROUP BY 1")
def window_unresolved(spark, sf):
    rows = B.feeds(spark, sf).where(C.in_window(F.col("posted_at"), D1))
    return rows.groupBy("code").agg(F.bool_or(~O.source_ticker_valid(F.col("source_ticker"), F.col("code"))).alias("unresolved"))


@query("p2_partial_day", B.ctes("feeds") + f" SELECT code, count(*) AS posts FROM feeds WHERE posted_at >= TIMESTAMP '{C.utc_bounds(C.build_range('d0', B.ANCHOR))[0]}' AND posted_at <= TIMESTAMP '2024-01-30 00:30:00' GROUP BY 1")
def partial_day(spark, sf):
    from datetime import datetime

    r = C.build_range("d0", B.ANCHOR)
    return B.feeds(spark, sf).where(C.in_window(F.col("posted_at"), r, datetime(2024, 1, 30, 0, 30))).groupBy("code").agg(F.count(F.lit(1)).alias("posts"))


@query("a35_filter_audit", BASE + ", r AS (SELECT feed_id, count(*) AS n FROM comments GROUP BY 1) SELECT f.code, count(*) AS raw_posts, count(q.feed_id) AS qualifying, CAST(coalesce(sum(f.comment_count), 0) AS BIGINT) AS platform_before, CAST(coalesce(sum(CASE WHEN q.feed_id IS NOT NULL THEN f.comment_count END), 0) AS BIGINT) AS platform_after, CAST(coalesce(sum(CASE WHEN q.feed_id IS NOT NULL THEN r.n END), 0) AS BIGINT) AS parsed_replies, CAST(sum(CASE WHEN coalesce(upper(f.source_ticker) = upper('0' || f.code || '.HK'), false) THEN 0 ELSE 1 END) AS BIGINT) AS invalid FROM feeds f LEFT JOIN q USING (feed_id) LEFT JOIN r ON r.feed_id = f.feed_id GROUP BY 1")
def filter_audit(spark, sf):
    feeds = B.feeds(spark, sf)
    ok = O.qualified(feeds, B.mentions(spark, sf), {"error": "exact"}).select("feed_id", F.lit(True).alias("ok"))
    rows = feeds.join(ok, "feed_id", "left").join(O.reply_sums(B.comments(spark, sf)), "feed_id", "left")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return rows.groupBy("code").agg(
        F.count(F.lit(1)).alias("raw_posts"), F.count("ok").alias("qualifying"), zero("comment_count").alias("platform_before"), zero(F.when(F.col("ok"), F.col("comment_count"))).alias("platform_after"),
        zero(F.when(F.col("ok"), F.col("replies"))).alias("parsed_replies"), F.count_if(~O.source_ticker_valid(F.col("source_ticker"), F.col("code"))).alias("invalid"),
    )


@query("a6_null_infectious_sum", B.ctes("feeds") + " SELECT author_uid, CASE WHEN count(*) = count(share_count) THEN CAST(coalesce(sum(share_count), 0) AS BIGINT) END AS shares FROM feeds GROUP BY 1")
def null_infectious_sum(spark, sf):
    return B.feeds(spark, sf).groupBy("author_uid").agg(M.null_infectious_sum(F.col("share_count")).alias("shares"))


@query("a7_lower_bound_sum", B.ctes("feeds") + " SELECT code, CAST(coalesce(sum(share_count), 0) AS BIGINT) AS known, count(*) - count(share_count) AS unknown, round(CAST(count(share_count) AS DOUBLE) / count(*), 4) AS coverage FROM feeds GROUP BY 1")
def lower_bound_sum(spark, sf):
    n = F.count("share_count")
    return B.feeds(spark, sf).groupBy("code").agg(F.coalesce(F.sum("share_count"), F.lit(0)).alias("known"), (F.count(F.lit(1)) - n).alias("unknown"), F.round(n / F.count(F.lit(1)), 4).alias("coverage"))


@query("a8_group_count", BASE + f" SELECT code, count(*) AS posts FROM q WHERE {window_sql(D14)} GROUP BY 1")
def group_count(spark, sf):
    return posts(spark, sf, D14).groupBy("code").agg(F.count(F.lit(1)).alias("posts"))


@query("a11_comment_clock", B.ctes("feeds", "comments") + " SELECT f.code, count(c.comment_id) AS n, count(CASE WHEN c.k % 8 <> 0 THEN c.commented_at END) AS timed, CASE WHEN count(c.comment_id) = 0 THEN 'empty' WHEN count(CASE WHEN c.k % 8 <> 0 THEN c.commented_at END) = 0 THEN 'unavailable' WHEN count(CASE WHEN c.k % 8 <> 0 THEN c.commented_at END) < count(c.comment_id) THEN 'partial' ELSE 'ok' END AS status FROM feeds f LEFT JOIN comments c USING (feed_id) GROUP BY 1")
def comment_clock(spark, sf):
    c = B.comments(spark, sf).select("feed_id", "comment_id", F.when(F.col("k") % 8 != 0, F.col("commented_at")).alias("at"))
    out = B.feeds(spark, sf).select("feed_id", "code").join(c, "feed_id", "left").groupBy("code").agg(F.count("comment_id").alias("n"), F.count("at").alias("timed"))
    return out.withColumn("status", F.when(F.col("n") == 0, "empty").when(F.col("timed") == 0, "unavailable").when(F.col("timed") < F.col("n"), "partial").otherwise("ok"))


@query("t14_t15_sliding_presets", BASE + ", r(key, lo, hi) AS (VALUES " + ", ".join(f"('{k}', TIMESTAMP '{lo}', TIMESTAMP '{hi}')" for k in ("d1", "d2", "d7", "d14") for lo, hi in [C.utc_bounds(C.build_range(k, B.ANCHOR))]) + ") SELECT r.key AS range_key, q.code, count(*) AS posts FROM q JOIN r ON q.posted_at >= r.lo AND q.posted_at < r.hi GROUP BY 1, 2")
def sliding_presets(spark, sf):
    keys = ("d1", "d2", "d7", "d14")
    rows = posts(spark, sf, D14)  # the widest window holds the others
    inside = F.array(*[F.when(C.in_window(F.col("posted_at"), C.build_range(k, B.ANCHOR)), F.lit(k)) for k in keys])
    return rows.select("code", F.explode(F.array_compact(inside)).alias("range_key")).groupBy("range_key", "code").agg(F.count(F.lit(1)).alias("posts"))


BAR_DAY = B.ctes("bars") + ", d AS (SELECT code, session_date, arg_min(price, seq * 10 + sub) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq * 10 + sub) AS close, CAST(sum(volume) AS BIGINT) AS volume FROM bars GROUP BY 1, 2)"


def _daily(spark, sf):
    return P.day_bars(B.bars(spark, sf))


@query("a20_day_bars", BAR_DAY + " SELECT code, CAST(session_date AS VARCHAR) AS day, open, high, low, close, volume FROM d")
def day_bars(spark, sf):
    return _daily(spark, sf).select("code", F.col("session_date").cast("string").alias("day"), "open", "high", "low", "close", "volume")


@query("a20_week_bars", BAR_DAY + ", w AS (SELECT code, CAST(floor(date_diff('day', DATE '1990-01-01', session_date) / 7) AS INTEGER) AS week, arg_min(open, session_date) AS open, max(high) AS high, min(low) AS low, arg_max(close, session_date) AS close, count(*) AS sessions FROM d GROUP BY 1, 2) SELECT code, week, CASE WHEN sessions = 7 THEN open END AS open, CASE WHEN sessions = 7 THEN high END AS high, CASE WHEN sessions = 7 THEN low END AS low, CASE WHEN sessions = 7 THEN close END AS close FROM w")
def week_bars(spark, sf):
    from datetime import date

    return P.resample(_daily(spark, sf), date(1990, 1, 1), 7)


@query("v30_bar_conflicts", B.ctes("bars") + " SELECT code, count(*) AS conflicts FROM (SELECT code, session_date, seq FROM bars GROUP BY 1, 2, 3 HAVING count(DISTINCT price) > 1) GROUP BY 1")
def bar_conflicts(spark, sf):
    return P.conflicts(B.bars(spark, sf), ["code", "session_date", "seq"]).groupBy("code").agg(F.count(F.lit(1)).alias("conflicts"))


@query("v31_provider_switch", BAR_DAY + ", n AS (SELECT code, count(*) AS sessions FROM d GROUP BY 1) SELECT code, sessions, sessions = (SELECT max(sessions) FROM n) AS complete, (SELECT bool_and(sessions >= 300) FROM n) AS switch FROM n")
def provider_switch(spark, sf):
    n = _daily(spark, sf).groupBy("code").agg(F.count(F.lit(1)).alias("sessions"))
    whole = n.agg(F.max("sessions").alias("_m"), F.bool_and(F.col("sessions") >= 300).alias("switch"))
    return n.crossJoin(F.broadcast(whole)).select("code", "sessions", (F.col("sessions") == F.col("_m")).alias("complete"), "switch")


@query("j17_slot_prices", BAR_DAY + ", slots AS (SELECT CAST(c AS VARCHAR) AS code, CAST(DATE '1996-01-01' + CAST(i AS INTEGER) AS DATE) AS day FROM range(10) a(c), range(30) b(i)) SELECT s.code, CAST(s.day AS VARCHAR) AS day, d.close, d.close IS NULL AS missing FROM slots s LEFT JOIN d ON d.code = s.code AND d.session_date = s.day")
def slot_prices(spark, sf):
    slots = spark.range(10).select(F.col("id").cast("string").alias("code"), F.explode(F.sequence(F.lit("1996-01-01").cast("date"), F.lit("1996-01-30").cast("date"))).alias("session_date"))
    out = slots.join(_daily(spark, sf).select("code", "session_date", "close"), ["code", "session_date"], "left")
    return out.select("code", F.col("session_date").cast("string").alias("day"), "close", F.col("close").isNull().alias("missing"))
