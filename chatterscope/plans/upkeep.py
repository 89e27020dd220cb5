"""Upkeep queries: merging, queue, audit, sampling, evaluation, catalog and source operators."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chatterscope.functions import calendar as C
from chatterscope.functions import metrics as M
from chatterscope.operators import facts as T
from chatterscope.operators import sampling as S
from chatterscope.plans.catalog import query
from chatterscope.plans.opinions import JOBS, jobs
from chatterscope.sources import bindings as B
from chatterscope.sources import keyset as K

BASE = B.ctes("feeds", "comments", "products") + f", {JOBS}"


@query("s4_t2_keyset_page", "SELECT event_id, ts FROM events WHERE (ts > TIMESTAMP '2024-01-10 00:00:00' OR (ts = TIMESTAMP '2024-01-10 00:00:00' AND event_id > 10)) AND (ts < TIMESTAMP '2024-01-20 00:00:00' OR (ts = TIMESTAMP '2024-01-20 00:00:00' AND event_id <= 999999)) ORDER BY ts, event_id LIMIT 1000")
def keyset_page(spark, sf):
    return K.page(B.read(spark, sf, "events").select("event_id", "ts"), "ts", "event_id", (datetime(2024, 1, 10), 10), (datetime(2024, 1, 20), 999_999), 1000)


@query("s5_high_watermark", "SELECT event_type, max(ts) AS ts, arg_max(event_id, ts) AS event_id FROM events GROUP BY 1")
def high_watermark(spark, sf):
    return B.read(spark, sf, "events").groupBy("event_type").agg(F.max(F.struct("ts", "event_id")).alias("m")).select("event_type", "m.ts", "m.event_id")


@query("s6_targeted_scan", BASE + " SELECT feed_id, CASE WHEN k % 4 <> 0 THEN posted_at + INTERVAL 1 HOUR ELSE posted_at END AS observed_at FROM feeds WHERE feed_id IN (SELECT feed_id FROM comments WHERE k = 7)")
def targeted_scan(spark, sf):
    rows = B.feeds(spark, sf).withColumn("later", F.when(F.col("k") % 4 != 0, F.col("posted_at") + F.expr("INTERVAL 1 HOUR")))
    return K.targeted(rows, B.comments(spark, sf).where("k = 7"), "feed_id", ["posted_at", "later"]).select("feed_id", "observed_at")


@query("s15_a32_copy_verification", "SELECT count(*) AS n, CAST(sum(CAST(('0x' || substr(md5(concat_ws('|', event_id, user_id, event_type)), 1, 12)) AS BIGINT) % 1000003) AS BIGINT) AS digest FROM events")
def copy_verification(spark, sf):
    """An order-insensitive digest of a table: two copies agree on count and sum."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", "event_id", "user_id", "event_type")), 1, 12), 16, 10).cast("long") % 1_000_003
    return B.read(spark, sf, "events").agg(F.count(F.lit(1)).alias("n"), F.sum(h).alias("digest"))


@query("s18_retained_events", "SELECT event_id FROM events ORDER BY event_id DESC LIMIT 5000")
def retained_events(spark, sf):
    return B.read(spark, sf, "events").select("event_id").orderBy(F.desc("event_id")).limit(5000)


@query("l5_cursor_page", "SELECT event_id, event_type FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 200")
def cursor_page(spark, sf):
    return B.read(spark, sf, "events").where("event_id > 500").select("event_id", "event_type").orderBy("event_id").limit(200)


SNAP = ", old AS (SELECT feed_id, code, like_count AS likes, share_count AS shares FROM feeds WHERE k % 3 <> 0), new AS (SELECT feed_id, upper(code) AS code, CASE WHEN k % 5 <> 0 THEN like_count + 1 END AS likes, share_count AS shares FROM feeds WHERE k % 4 <> 0)"


def snapshots(spark, sf):
    f = B.feeds(spark, sf)
    old = f.where("k % 3 <> 0").select("feed_id", "code", F.col("like_count").alias("likes"), F.col("share_count").alias("shares"))
    new = f.where("k % 4 <> 0").select("feed_id", F.upper("code").alias("code"), F.when(F.col("k") % 5 != 0, F.col("like_count") + 1).alias("likes"), F.col("share_count").alias("shares"))
    return old, new


@query("t7_s14_snapshot_merge", BASE + SNAP + " SELECT feed_id, coalesce(o.code, n.code) AS code, coalesce(n.likes, o.likes) AS likes, coalesce(n.shares, o.shares) AS shares FROM old o FULL JOIN new n USING (feed_id)")
def snapshot_merge(spark, sf):
    return T.merge_snapshot(*snapshots(spark, sf), "feed_id", ["code"], ["likes", "shares"])


@query("u4_t9_set_diff", BASE + SNAP + " SELECT feed_id, CASE WHEN o.code IS NULL THEN 'added' WHEN n.code IS NULL THEN 'removed' ELSE 'retained' END AS change FROM old o FULL JOIN new n USING (feed_id)")
def set_diff(spark, sf):
    return T.set_diff(*snapshots(spark, sf), "feed_id")


@query("j20_full_comparison", BASE + SNAP + " SELECT CASE WHEN n.code IS NULL THEN 'extra' WHEN o.code IS NULL THEN 'missing' WHEN o.likes IS NOT DISTINCT FROM n.likes AND o.shares IS NOT DISTINCT FROM n.shares THEN 'equal' ELSE 'different' END AS kind, count(*) AS n FROM old o FULL JOIN new n USING (feed_id) GROUP BY 1")
def full_comparison(spark, sf):
    return T.compared(*snapshots(spark, sf), "feed_id", ["likes", "shares"])


@query("t8_child_reconcile", BASE + ", o AS (SELECT comment_id, feed_id, k AS v FROM comments WHERE k % 2 = 0), n AS (SELECT comment_id, feed_id, k + 100 AS v FROM comments WHERE k % 3 = 0), c AS (SELECT feed_id FROM feeds WHERE k % 2 = 0) SELECT comment_id, coalesce(n.feed_id, o.feed_id) AS feed_id, coalesce(n.v, o.v) AS v FROM o FULL JOIN n USING (comment_id) WHERE n.v IS NOT NULL OR o.feed_id NOT IN (SELECT feed_id FROM c)")
def child_reconcile(spark, sf):
    c = B.comments(spark, sf)
    old, new = c.where("k % 2 = 0").select("comment_id", "feed_id", F.col("k").alias("v")), c.where("k % 3 = 0").select("comment_id", "feed_id", (F.col("k") + 100).alias("v"))
    return T.reconcile_children(old, new, B.feeds(spark, sf).where("k % 2 = 0").select("feed_id"), "comment_id", "feed_id", "v")


@query("t12_dirty_products", BASE + SNAP + " SELECT o.code, count(*) AS changed FROM old o JOIN new n USING (feed_id) WHERE o.likes IS DISTINCT FROM coalesce(n.likes, o.likes) GROUP BY 1")
def dirty_products(spark, sf):
    old, new = snapshots(spark, sf)
    both = old.join(new.select("feed_id", F.col("likes").alias("_n")), "feed_id").where(~F.col("likes").eqNullSafe(F.coalesce("_n", "likes")))
    return both.groupBy("code").agg(F.count(F.lit(1)).alias("changed"))


@query("f29_touched_ranges", "WITH r(key, days) AS (VALUES ('d1', 1), ('d2', 2), ('d7', 7), ('d14', 14), ('d30', 30)), e AS (SELECT event_type AS code, date_diff('day', CAST(ts + INTERVAL 8 HOUR AS DATE), DATE '2024-01-29') AS age FROM events) SELECT code, key AS range_key, count(*) AS n FROM e JOIN r ON age >= 0 AND age < 2 * days GROUP BY 1, 2")
def touched_ranges(spark, sf):
    """A change touches every range whose window or baseline holds its day."""
    age = F.datediff(F.lit(B.ANCHOR), C.local_day(F.col("ts")))
    inside = F.array_compact(F.array(*[F.when((age >= 0) & (age < 2 * n), F.lit(k)) for k, n in C.PRESETS.items() if k != "d0"]))
    rows = B.read(spark, sf, "events").select(F.col("event_type").alias("code"), F.explode(inside).alias("range_key"))
    return rows.groupBy("code", "range_key").agg(F.count(F.lit(1)).alias("n"))


@query("a28_queue_matrix", BASE + " SELECT subject_code, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'dead') AS dead FROM jobs GROUP BY 1")
def queue_matrix(spark, sf):
    return jobs(spark, sf).groupBy("subject_code").pivot("status", ["pending", "running", "done", "dead"]).count().na.fill(0)


@query("a29_throughput", BASE + ", m AS (SELECT max(created_at) AS m FROM jobs) SELECT count(*) FILTER (status = 'done' AND created_at > m - INTERVAL 1 DAY) AS recent, count(*) FILTER (status = 'pending') AS pending, round(CAST(count(*) FILTER (status = 'pending') AS DOUBLE) / (CAST(count(*) FILTER (status = 'done' AND created_at > m - INTERVAL 1 DAY) AS DOUBLE) / 24), 6) AS eta_hours FROM jobs, m")
def throughput(spark, sf):
    j = jobs(spark, sf)
    last = F.broadcast(j.agg(F.max("created_at").alias("m")))
    out = j.crossJoin(last).agg(F.count_if((F.col("status") == "done") & (F.col("created_at") > F.col("m") - F.expr("INTERVAL 1 DAY"))).alias("recent"), F.count_if(F.col("status") == "pending").alias("pending"))
    return out.withColumn("eta_hours", F.round(F.try_divide(F.col("pending").cast("double"), F.col("recent").cast("double") / 24), 6))


@query("q1_claim_jobs", BASE + ", o AS (SELECT *, status = 'pending' OR (status = 'running' AND lease_until < TIMESTAMP '2024-01-20 00:00:00') AS open FROM jobs), r AS (SELECT *, open AND row_number() OVER (PARTITION BY open ORDER BY priority DESC, subject_code, job_id) <= 50 AS go FROM o) SELECT job_id, CASE WHEN go THEN 'running' ELSE status END AS status, CAST(attempts + CASE WHEN go THEN 1 ELSE 0 END AS BIGINT) AS attempts FROM r")
def claim_jobs(spark, sf):
    return T.claim(jobs(spark, sf), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), 50).select("job_id", "status", "attempts")


@query("q2_retry_or_dead", BASE + " SELECT status, count(*) AS n FROM (SELECT CASE WHEN priority % 2 = 0 AND attempts >= 3 THEN 'dead' WHEN priority % 2 = 0 THEN 'pending' ELSE status END AS status FROM jobs) GROUP BY 1")
def retry_or_dead(spark, sf):
    j = jobs(spark, sf)
    return T.retry_or_dead(j, j.where("priority % 2 = 0")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("v13_v40_supersede_jobs", BASE + " SELECT job_id, CASE WHEN status IN ('pending','running') AND subject_code NOT IN ('click','view') THEN 'superseded' ELSE status END AS status FROM jobs")
def supersede_jobs(spark, sf):
    valid = B.products(spark, sf).where("code in ('click', 'view')").select(F.col("code").alias("subject_code"))
    return T.superseded(jobs(spark, sf), valid, ["subject_code"]).select("job_id", "status")


@query("v12_new_work_units", BASE + ", u AS (SELECT comment_id AS target_id, said_code AS subject_code FROM comments) SELECT target_id, subject_code FROM u WHERE NOT EXISTS (SELECT 1 FROM jobs j WHERE j.target_id = u.target_id AND j.subject_code = u.subject_code)")
def new_work_units(spark, sf):
    u = B.comments(spark, sf).select(F.col("comment_id").alias("target_id"), F.col("said_code").alias("subject_code")).distinct()
    return u.join(jobs(spark, sf).select("target_id", "subject_code").distinct(), ["target_id", "subject_code"], "left_anti")


@query("v14_input_hash", BASE + " SELECT feed_id, sha256('{\"code\":\"' || code || '\",\"likes\":' || CAST(like_count AS VARCHAR) || '}') AS h FROM feeds")
def input_hash(spark, sf):
    return B.feeds(spark, sf).select("feed_id", F.sha2(F.to_json(F.struct("code", F.col("like_count").alias("likes"))), 256).alias("h"))


@query("w15_w16_priorities", BASE + ", a AS (SELECT feed_id, code, date_diff('day', CAST(posted_at + INTERVAL 8 HOUR AS DATE), DATE '2024-01-29') AS age, ownership FROM feeds JOIN products USING (code)) SELECT feed_id, CAST(CASE WHEN age <= 7 THEN 30 WHEN age <= 14 THEN 20 WHEN age <= 30 THEN 10 ELSE 0 END + CASE WHEN ownership = 'own' THEN 2 ELSE 0 END + CASE WHEN age < 7 THEN 1 ELSE 0 END AS INTEGER) AS priority FROM a")
def priorities(spark, sf):
    rows = B.feeds(spark, sf).join(B.products(spark, sf).select("code", "ownership"), "code").withColumn("age", F.datediff(F.lit(B.ANCHOR), C.local_day(F.col("posted_at"))))
    return rows.select("feed_id", M.recency_priority(F.col("age"), F.lit(False), F.col("ownership") == "own", F.col("age") < 7).alias("priority"))


@query("w17_latency_percentiles", "WITH x AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, max(value) FILTER (i = least(n - 1, CAST(floor(n * 0.5) AS BIGINT))) AS p50, max(value) FILTER (i = least(n - 1, CAST(floor(n * 0.95) AS BIGINT))) AS p95 FROM x GROUP BY 1")
def latency_percentiles(spark, sf):
    """Index rule: the element at floor(n p) of the sorted list, from the counts of the values."""
    w = W.partitionBy("event_type")
    x = B.read(spark, sf, "events").groupBy("event_type", "value").agg(F.count(F.lit(1)).alias("c"))
    x = x.select("event_type", "value", F.sum("c").over(w.orderBy("value")).alias("upto"), F.sum("c").over(w).alias("n"))
    at = lambda p: F.min(F.when(F.col("upto") > F.least(F.col("n") - 1, F.floor(F.col("n") * p)), F.col("value")))
    return x.groupBy("event_type").agg(at(0.5).alias("p50"), at(0.95).alias("p95"))


MD5 = "md5(concat_ws(':', '{seed}', {key}))"


@query("v38_simple_sample", f"SELECT doc_id, lang FROM documents ORDER BY {MD5.format(seed=7, key='doc_id')}, doc_id LIMIT 40")
def simple_sample(spark, sf):
    return S.simple_sample(B.read(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 40, 7)


@query("v16_v18_round_robin", f"SELECT doc_id, lang, CAST(turn AS INTEGER) AS turn FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {MD5.format(seed=3, key='doc_id')}, doc_id) AS turn FROM documents) ORDER BY turn, lang LIMIT 50")
def round_robin(spark, sf):
    return S.round_robin(B.read(spark, sf, "documents").select("doc_id", "lang"), ["lang"], "doc_id", 50, 3)


QUOTAS = "WITH s AS (SELECT lang, count(*) AS c FROM documents GROUP BY 1), m AS (SELECT CAST(sum(c) AS BIGINT) AS m FROM s), q AS (SELECT lang, greatest(1, 60 * c // m) AS q, row_number() OVER (ORDER BY 60 * c % m DESC, lang) AS r FROM s, m), d AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(concat_ws(':', '5', doc_id)), doc_id) AS i FROM documents)"


@query("v17_stratified_sample", QUOTAS + " SELECT doc_id, d.lang FROM d JOIN q USING (lang) WHERE i <= q + CASE WHEN r <= 60 - (SELECT sum(q) FROM q) THEN 1 ELSE 0 END")
def stratified_sample(spark, sf):
    return S.stratified(B.read(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id", 60, 5)


def gold(spark, sf):
    """Gold against a rule on length."""
    docs = B.read(spark, sf, "documents").select("doc_id", "lang", F.when(F.col("n_chars") % 3 == 0, 0).otherwise(1).alias("model"))
    return B.read(spark, sf, "labels").join(docs, "doc_id")


GOLD = "WITH g AS (SELECT l.doc_id, lang, quality, toxic, CASE WHEN n_chars % 3 = 0 THEN 0 ELSE 1 END AS model FROM labels l JOIN documents d USING (doc_id))"


@query("v19_confusion", GOLD + " SELECT quality, model, count(*) AS n FROM g GROUP BY 1, 2")
def confusion(spark, sf):
    return S.confusion(gold(spark, sf), "quality", "model")


@query("v19_class_scores", GOLD + ", e AS (SELECT quality AS label, 1 AS g, 0 AS m, CASE WHEN quality = model THEN 1 ELSE 0 END AS hit FROM g UNION ALL SELECT model, 0, 1, 0 FROM g), t AS (SELECT label, CAST(sum(g) AS BIGINT) AS gold_n, CAST(sum(m) AS DOUBLE) AS mn, CAST(sum(hit) AS DOUBLE) AS h FROM e GROUP BY 1) SELECT label, gold_n, round_even(h / mn, 4) AS precision, round_even(h / gold_n, 4) AS recall, round_even(2 * (h / mn) * (h / gold_n) / (h / mn + h / gold_n), 4) AS f1 FROM t WHERE gold_n > 0")
def class_scores(spark, sf):
    return S.scores(gold(spark, sf), "quality", "model")


@query("v21_v22_gates", GOLD + " SELECT count(*) AS n, round_even(avg(CASE WHEN quality = model THEN CAST(1 AS DOUBLE) ELSE 0 END), 4) AS rate, count(*) >= 300 AND round_even(avg(CASE WHEN quality = model THEN CAST(1 AS DOUBLE) ELSE 0 END), 4) >= 0.9 AS passes FROM g")
def gates(spark, sf):
    g = gold(spark, sf)
    a = S.agreement(g.select("doc_id", F.col("quality").alias("label")), g.select("doc_id", F.col("model").alias("label")), "doc_id", "label")
    return a.withColumn("passes", (F.col("n") >= 300) & (F.col("rate") >= 0.9))


@query("v23_disputed", GOLD + " SELECT doc_id, quality, model FROM g WHERE quality <> model")
def disputed(spark, sf):
    return gold(spark, sf).where("quality <> model").select("doc_id", "quality", "model")


@query("v20_routed_labels", GOLD + " SELECT CASE WHEN doc_id % 100 >= 85 AND doc_id % 90 >= 70 THEN 'student' ELSE 'llm' END AS route, count(*) AS n FROM g GROUP BY 1")
def routed_labels(spark, sf):
    sure = ((F.col("doc_id") % 100) / 100 >= 0.85) & (F.col("doc_id") % 90 >= 70)
    return gold(spark, sf).groupBy(F.when(sure, "student").otherwise("llm").alias("route")).agg(F.count(F.lit(1)).alias("n"))


@query("j19_gold_by_text", "SELECT md5(text) AS h, min(quality) AS quality FROM labels JOIN documents USING (doc_id) GROUP BY 1 HAVING count(DISTINCT quality) = 1")
def gold_by_text(spark, sf):
    rows = B.read(spark, sf, "labels").join(B.read(spark, sf, "documents").select("doc_id", F.md5("text").alias("h")), "doc_id")
    return rows.groupBy("h").agg(F.min("quality").alias("quality"), F.count_distinct("quality").alias("_n")).where("_n = 1").drop("_n")


@query("v15_batch_packing")
def batch_packing(spark, sf):
    rows = B.read(spark, sf, "conversations").select("conv_id", (F.col("turn")).alias("turn"), "text")
    return S.pack_batches(rows, "conv_id", "turn", "text", 3, 800, 6000)


@query("v24_catalog_class", "WITH p AS (SELECT p_partkey AS id, p_brand, p_type, p_partkey % 4 = 0 AS own FROM part), o AS (SELECT p_brand, p_type, count(*) AS n, min(id) AS own_id FROM p WHERE own GROUP BY 1, 2) SELECT p.id, CASE WHEN p.own THEN 'own' WHEN o.n = 1 THEN 'exact_peer' WHEN o.n > 1 THEN 'ambiguous' ELSE 'unmatched' END AS class, CASE WHEN NOT p.own AND o.n = 1 THEN own_id END AS own_id FROM p LEFT JOIN o USING (p_brand, p_type)")
def catalog_class(spark, sf):
    p = B.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_type", (F.col("p_partkey") % 4 == 0).alias("own"))
    o = p.where("own").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("_o"))
    rows = p.join(o, ["p_brand", "p_type"], "left")
    kind = F.when(F.col("own"), "own").when(F.col("n") == 1, "exact_peer").when(F.col("n") > 1, "ambiguous").otherwise("unmatched")
    return rows.select("id", kind.alias("class"), F.when(~F.col("own") & (F.col("n") == 1), F.col("_o")).alias("own_id"))


@query("v25_catalog_merge", "WITH o AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS seg FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name END AS name, CASE WHEN c_custkey % 7 = 0 THEN 'OTHER' ELSE c_mktsegment END AS seg FROM customer WHERE c_custkey % 4 <> 0) SELECT id, coalesce(nullif(n.name, ''), o.name) AS name, coalesce(o.seg, n.seg) AS seg, CASE WHEN n.id IS NULL THEN 'inactive' ELSE 'active' END AS status FROM o FULL JOIN n USING (id)")
def catalog_merge(spark, sf):
    """Observed values win unless blank, a conflict in segment keeps the old one, absent rows become inactive."""
    c = B.read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg"))
    old = c.where("id % 3 <> 0").select("id", F.col("name").alias("_on"), F.col("seg").alias("_os"))
    new = c.where("id % 4 <> 0").select("id", F.when(F.col("id") % 5 == 0, "").otherwise(F.col("name")).alias("_nn"), F.when(F.col("id") % 7 == 0, "OTHER").otherwise(F.col("seg")).alias("_ns"), F.lit(True).alias("_seen"))
    return old.join(new, "id", "full_outer").select("id", F.coalesce(F.nullif("_nn", F.lit("")), "_on").alias("name"), F.coalesce("_os", "_ns").alias("seg"), F.when(F.col("_seen"), "active").otherwise("inactive").alias("status"))


@query("f14_new_listing", BASE + " SELECT code, date_diff('day', listing_date, DATE '2024-01-29') BETWEEN 0 AND 9 AS is_new FROM products")
def new_listing(spark, sf):
    return B.products(spark, sf).select("code", M.new_listing(F.col("listing_date"), F.lit(date(2024, 1, 29)), 10).alias("is_new"))


@query("f70_f71_json_paths", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id % 50 = 0 AS broken FROM events WHERE event_id % 50 <> 0 UNION ALL SELECT event_id, NULL, true FROM events WHERE event_id % 50 = 0")
def json_paths(spark, sf):
    """Cut texts parse to null with a flag, and the value is looked for at three places."""
    raw = F.when(F.col("event_id") % 50 == 0, F.substring("props", 1, 3)).otherwise(F.col("props"))
    v = F.try_parse_json(raw)
    k = F.coalesce(*[F.try_variant_get(v, p, "bigint") for p in ("$.common.k", "$.feed.k", "$.k")])
    return B.read(spark, sf, "events").select("event_id", k.alias("k"), v.isNull().alias("broken"))


@query("f72_nested_explode", "SELECT event_id * 10 + 1 AS child, event_id FROM events UNION ALL SELECT event_id * 10 + 2, event_id FROM events")
def nested_explode(spark, sf):
    """Children explode with their place; of one id the first stays."""
    ids = F.array(F.col("event_id") * 10 + 1, F.col("event_id") * 10 + 2, F.col("event_id") * 10 + 1)
    raw = F.to_json(F.transform(ids, lambda i: F.struct(i.alias("comment_id"))))
    rows = B.read(spark, sf, "events").select("event_id", F.posexplode(F.from_json(raw, "array<struct<comment_id:long>>")).alias("pos", "c"))
    return rows.groupBy(F.col("c.comment_id").alias("child")).agg(F.min_by("event_id", "pos").alias("event_id"))


@query("a9_f73_coverage_folds", BASE + ", c AS (SELECT feed_id, CASE k % 7 WHEN 0 THEN 'retryable_incomplete' WHEN 1 THEN 'partial' WHEN 2 THEN 'unknown' ELSE 'complete' END AS s FROM feeds) SELECT author_uid, CASE WHEN bool_or(s IN ('partial','retryable_incomplete')) THEN 'partial' WHEN bool_and(s = 'complete') THEN 'complete' ELSE 'unknown' END AS strict, CASE WHEN bool_or(s = 'retryable_incomplete') THEN 'retryable_incomplete' WHEN bool_or(s = 'partial') THEN 'partial' WHEN bool_and(s = 'complete') THEN 'complete' ELSE 'unknown' END AS detailed FROM feeds JOIN c USING (feed_id) GROUP BY 1")
def coverage_folds(spark, sf):
    k = F.col("k") % 7
    s = F.when(k == 0, "retryable_incomplete").when(k == 1, "partial").when(k == 2, "unknown").otherwise("complete")
    any_ = lambda *v: F.bool_or(s.isin(*v))
    rest = F.when(F.bool_and(s == "complete"), "complete").otherwise("unknown")
    strict = F.when(any_("partial", "retryable_incomplete"), "partial").otherwise(rest)
    detailed = F.when(any_("retryable_incomplete"), "retryable_incomplete").when(any_("partial"), "partial").otherwise(rest)
    return B.feeds(spark, sf).groupBy("author_uid").agg(strict.alias("strict"), detailed.alias("detailed"))


@query("a10_w7_latest_run", BASE + " SELECT subject_code, arg_max(status, (epoch_us(created_at) - 1704067200000000) * 100000 + job_id) AS status, CASE WHEN max(CASE WHEN status = 'done' THEN created_at END) >= TIMESTAMP '2024-01-29 00:00:00' THEN 'fresh' ELSE 'stale' END AS freshness FROM jobs GROUP BY 1")
def latest_run(spark, sf):
    done = F.max(F.when(F.col("status") == "done", F.col("created_at")))
    fresh = F.when(done >= F.lit("2024-01-29 00:00:00").cast("timestamp_ntz"), "fresh").otherwise("stale")
    return jobs(spark, sf).groupBy("subject_code").agg(F.max_by("status", F.struct("created_at", "job_id")).alias("status"), fresh.alias("freshness"))


@query("t5_completion_watermark", "WITH d AS (SELECT CAST(ts + INTERVAL 8 HOUR AS DATE) AS day, count(DISTINCT event_type) AS kinds, count(*) AS n FROM events GROUP BY 1) SELECT CAST(max(day) AS VARCHAR) AS watermark, count(*) AS proved FROM d WHERE kinds = (SELECT count(DISTINCT event_type) FROM events) AND n >= 5")
def completion_watermark(spark, sf):
    """The last day proved complete: every configured product was attempted and seen."""
    d = B.read(spark, sf, "events").groupBy(C.local_day(F.col("ts")).alias("day")).agg(F.count_distinct("event_type").alias("kinds"), F.count(F.lit(1)).alias("n"))
    whole = F.broadcast(B.read(spark, sf, "events").agg(F.count_distinct("event_type").alias("all")))
    return d.crossJoin(whole).where("kinds = all and n >= 5").agg(F.max("day").cast("string").alias("watermark"), F.count(F.lit(1)).alias("proved"))


@query("t17_daily_budget", BASE + ", r AS (SELECT job_id, CAST(created_at + INTERVAL 8 HOUR AS DATE) AS day, row_number() OVER (PARTITION BY CAST(created_at + INTERVAL 8 HOUR AS DATE) ORDER BY created_at, job_id) AS i FROM jobs) SELECT CAST(day AS VARCHAR) AS day, count(*) FILTER (i <= 100) AS granted, count(*) FILTER (i > 100) AS refused FROM r GROUP BY 1")
def daily_budget(spark, sf):
    n = jobs(spark, sf).groupBy(C.local_day(F.col("created_at")).cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("day", F.least("n", F.lit(100)).cast("long").alias("granted"), F.greatest(F.col("n") - 100, F.lit(0)).cast("long").alias("refused"))


@query("t13_range_ready", BASE + ", pend AS (SELECT DISTINCT subject_code AS code, date_diff('day', CAST(created_at + INTERVAL 8 HOUR AS DATE), DATE '2024-01-29') AS age FROM jobs WHERE status = 'pending' AND priority >= 38), r(key, days) AS (VALUES ('d1', 1), ('d7', 7), ('d14', 14)) SELECT p.code, r.key AS range_key FROM products p, r WHERE NOT EXISTS (SELECT 1 FROM pend WHERE pend.code = p.code AND age >= 0 AND age < 2 * r.days)")
def range_ready(spark, sf):
    """A (product, range) is ready once no pending day lies in its window or baseline."""
    age = F.datediff(F.lit(B.ANCHOR), C.local_day(F.col("created_at")))
    days = {k: C.PRESETS[k] for k in ("d1", "d7", "d14")}
    hit = F.array_compact(F.array(*[F.when((age >= 0) & (age < 2 * n), F.lit(k)) for k, n in days.items()]))
    open_ = jobs(spark, sf).where("status = 'pending' and priority >= 38").select(F.col("subject_code").alias("code"), F.explode(hit).alias("range_key")).distinct()
    spine = B.products(spark, sf).select("code", F.explode(F.array(*map(F.lit, days))).alias("range_key"))
    return spine.join(open_, ["code", "range_key"], "left_anti")


@query("u1_u2_u3_set_algebra", BASE + ", a AS (SELECT DISTINCT target_id FROM jobs WHERE status = 'done'), b AS (SELECT comment_id AS target_id FROM comments WHERE k % 2 = 0), x AS (SELECT feed_id AS target_id FROM feeds WHERE k % 3 = 0) SELECT target_id FROM (SELECT target_id FROM a UNION SELECT target_id FROM b) WHERE target_id NOT IN (SELECT target_id FROM x)")
def set_algebra(spark, sf):
    a = jobs(spark, sf).where("status = 'done'").select("target_id")
    b = B.comments(spark, sf).where("k % 2 = 0").select(F.col("comment_id").alias("target_id"))
    x = B.feeds(spark, sf).where("k % 3 = 0").select(F.col("feed_id").alias("target_id"))
    return a.unionByName(b).distinct().join(x, "target_id", "left_anti")


@query("u5_first_wins", BASE + ", u AS (SELECT feed_id AS id, 'a' AS origin, 0 AS p FROM feeds WHERE k % 2 = 0 UNION ALL SELECT feed_id, 'b', 1 FROM feeds WHERE k % 3 = 0) SELECT id, arg_min(origin, p) AS origin FROM u GROUP BY 1")
def first_wins(spark, sf):
    f = B.feeds(spark, sf)
    pick = lambda m, n: f.where(f"k % {m} = 0").select(F.col("feed_id").alias("id"), F.lit(n).alias("origin"))
    return T.first_wins(pick(2, "a"), pick(3, "b"), ["id"])


@query("v34_source_ticker_resolution", BASE + ", stored AS (SELECT feed_id, code, source_ticker AS t FROM feeds), one AS (SELECT code, min(source_ticker) AS t FROM feeds WHERE source_ticker IS NOT NULL GROUP BY 1 HAVING count(DISTINCT source_ticker) = 1) SELECT feed_id, coalesce(stored.t, one.t) AS ticker, CASE WHEN stored.t IS NOT NULL THEN 'stored' WHEN one.t IS NOT NULL THEN 'unique' ELSE 'unresolved' END AS origin FROM stored LEFT JOIN one USING (code)")
def source_ticker_resolution(spark, sf):
    f = B.feeds(spark, sf)
    one = f.where("source_ticker is not null").groupBy("code").agg(F.min("source_ticker").alias("_t"), F.count_distinct("source_ticker").alias("_n")).where("_n = 1")
    out = f.join(one, "code", "left")
    return out.select("feed_id", F.coalesce("source_ticker", "_t").alias("ticker"), F.when(F.col("source_ticker").isNotNull(), "stored").when(F.col("_t").isNotNull(), "unique").otherwise("unresolved").alias("origin"))


@query("a30_audit_report", BASE + ", s AS (SELECT subject_code, count(*) AS n, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'dead') AS dead FROM jobs GROUP BY 1) SELECT subject_code, n, done, dead, round_even(CAST(done AS DOUBLE) / n, 4) AS completion, CAST(row_number() OVER (ORDER BY dead DESC, subject_code) AS INTEGER) AS place FROM s")
def audit_report(spark, sf):
    s = jobs(spark, sf).groupBy("subject_code").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "dead").alias("dead"))
    return s.withColumns({"completion": F.bround(F.col("done") / F.col("n"), 4), "place": F.row_number().over(W.orderBy(F.desc("dead"), "subject_code"))})


@query("a37_candidate_counts", BASE + " SELECT f.code, count(*) AS n FROM comments c JOIN feeds f USING (feed_id) WHERE c.k % 9 <> 0 GROUP BY 1")
def candidate_counts(spark, sf):
    return B.comments(spark, sf).where("k % 9 <> 0").join(B.feeds(spark, sf).select("feed_id", "code"), "feed_id").groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("a38_collector_freshness", "WITH d AS (SELECT CAST(ts + INTERVAL 8 HOUR AS DATE) AS day, event_type FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) % 4 <> 0 GROUP BY 1, 2) SELECT CAST(day AS VARCHAR) AS day, count(*) AS seen, count(*) = (SELECT count(DISTINCT event_type) FROM events) AS complete FROM d GROUP BY day")
def collector_freshness(spark, sf):
    e = B.read(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    d = e.where("k % 4 <> 0").groupBy(C.local_day(F.col("ts")).cast("string").alias("day")).agg(F.count_distinct("event_type").alias("seen"))
    return d.crossJoin(F.broadcast(e.agg(F.count_distinct("event_type").alias("_all")))).select("day", "seen", (F.col("seen") == F.col("_all")).alias("complete"))


@query("v39_analysis_plan", "WITH r(key, days) AS (VALUES ('d1', 1), ('d7', 7), ('d14', 14)), x AS (SELECT key, CAST(i AS INTEGER) AS age, row_number() OVER (ORDER BY days, i) AS o FROM r, range(28) t(i) WHERE i < 2 * days) SELECT CAST(DATE '2024-01-29' - age AS VARCHAR) AS day, CAST(min(o) AS INTEGER) AS place, arg_min(key, o) AS range_key FROM x GROUP BY age")
def analysis_plan(spark, sf):
    """Shortest range first, newest day first, current before baseline; a day stands where it comes first. A few rows, made on the driver."""
    order: dict[date, tuple[int, str]] = {}
    place = 0
    for key in ("d1", "d7", "d14"):
        for age in range(2 * C.PRESETS[key]):
            place += 1
            order.setdefault(date.fromordinal(B.ANCHOR.toordinal() - age), (place, key))
    return spark.createDataFrame([(str(d), p, k) for d, (p, k) in order.items()], "day string, place int, range_key string")


@query("v33_management_view", BASE + " SELECT ownership, CASE WHEN count(*) = count(share_count) THEN CAST(sum(share_count) AS VARCHAR) ELSE '>=' || CAST(coalesce(sum(share_count), 0) AS VARCHAR) END AS told, count(DISTINCT CASE WHEN share_count IS NOT NULL THEN code END) AS covered FROM feeds JOIN products USING (code) GROUP BY 1")
def management_view(spark, sf):
    rows = B.feeds(spark, sf).join(B.products(spark, sf).select("code", "ownership"), "code")
    total = F.coalesce(F.sum("share_count"), F.lit(0)).cast("string")
    told = F.when(F.count(F.lit(1)) == F.count("share_count"), total).otherwise(F.concat(F.lit(">="), total))
    return rows.groupBy("ownership").agg(told.alias("told"), F.count_distinct(F.when(F.col("share_count").isNotNull(), F.col("code"))).alias("covered"))
