"""Reviews, published generations, coverage proofs, attribution, recovery, catalogs and layouts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chatterscope.functions import calendar as C
from chatterscope.functions import recovery as R
from chatterscope.functions import text as X
from chatterscope.operators import facts as T
from chatterscope.operators import dictionary
from chatterscope.plans.catalog import query
from chatterscope.plans.market import D7, window_sql
from chatterscope.plans.opinions import CURRENT, JOBS, KEYS, jobs
from chatterscope.sources import bindings as B

BASE = B.ctes("feeds", "comments", "products", "annotations") + f", {JOBS}"
FRESH = "n AS (SELECT annotation_id + 1000000000 AS annotation_id, attitude, annotation_id AS supersedes_id FROM annotations WHERE annotation_id % 17 = 0)"


@query("v5_review_decisions", BASE + f", {FRESH} SELECT annotation_id, CASE WHEN annotation_id % 17 = 0 THEN 'corrected' WHEN annotation_id % 13 = 0 THEN 'rejected' ELSE review_state END AS review_state, supersedes_id FROM annotations UNION ALL SELECT annotation_id, 'corrected', supersedes_id FROM n")
def review_decisions(spark, sf):
    """Decisions as a transition: a correction closes its row and adds one that supersedes it."""
    log = B.annotations(spark, sf)
    state = F.when(F.col("annotation_id") % 17 == 0, "corrected").when(F.col("annotation_id") % 13 == 0, "rejected").otherwise(F.col("review_state"))
    closed = log.select("annotation_id", state.alias("review_state"), "supersedes_id")
    fresh = log.where("annotation_id % 17 = 0").select((F.col("annotation_id") + 1_000_000_000).alias("annotation_id"), F.lit("corrected").alias("review_state"), F.col("annotation_id").alias("supersedes_id"))
    return closed.unionByName(fresh)


GEN = "g AS (SELECT event_id AS id, event_type AS code, CAST(ts + INTERVAL 8 HOUR AS DATE) AS anchor, k % 5 AS fingerprint FROM ev WHERE k % 6 = 0), pub AS (SELECT code, anchor, fingerprint, row_number() OVER (PARTITION BY code ORDER BY anchor DESC, id DESC) AS r FROM g WHERE anchor <= DATE '2024-01-20')"


@query("v7_published_generation", BASE + f", {GEN}, last AS (SELECT code, arg_max(fingerprint, id) AS now FROM g GROUP BY 1) SELECT code, CAST(anchor AS VARCHAR) AS anchor, fingerprint, fingerprint <> now AS stale FROM pub JOIN last USING (code) WHERE r = 1")
def published_generation(spark, sf):
    """The latest generation not after the anchor, and whether the inputs have changed since."""
    e = B._events(spark, sf).where("k % 6 = 0").select(F.col("event_id").alias("id"), F.col("event_type").alias("code"), C.local_day(F.col("ts")).alias("anchor"), (F.col("k") % 5).alias("fingerprint"))
    old = F.when(F.col("anchor") <= F.lit("2024-01-20").cast("date"), F.struct("anchor", "id"))
    g = e.groupBy("code").agg(F.max_by(F.struct("anchor", "fingerprint"), old).alias("p"), F.max_by("fingerprint", "id").alias("now"))
    return g.where("p is not null").select("code", F.col("p.anchor").cast("string").alias("anchor"), "p.fingerprint", (F.col("p.fingerprint") != F.col("now")).alias("stale"))


@query("v8_scope_coverage", BASE + ", s AS (SELECT subject_code AS code, min(CAST(created_at + INTERVAL 8 HOUR AS DATE)) AS lo, max(CAST(created_at + INTERVAL 8 HOUR AS DATE)) AS hi, count(*) FILTER (status IN ('pending','running') AND priority >= 39) AS open FROM jobs GROUP BY 1) SELECT code, lo <= DATE '2024-01-23' AND hi >= DATE '2024-01-29' AND open = 0 AS covered FROM s")
def scope_coverage(spark, sf):
    day = C.local_day(F.col("created_at"))
    s = jobs(spark, sf).groupBy(F.col("subject_code").alias("code")).agg(F.min(day).alias("lo"), F.max(day).alias("hi"), F.count_if(F.col("status").isin("pending", "running") & (F.col("priority") >= 39)).alias("open"))
    return s.select("code", ((F.col("lo") <= F.lit(D7.first)) & (F.col("hi") >= F.lit(D7.last)) & (F.col("open") == 0)).alias("covered"))


@query("v29_all_or_nothing", CURRENT + f", {JOBS}, c AS (SELECT DISTINCT author_uid, comment_id FROM comments), r AS (SELECT DISTINCT target_id FROM cur) SELECT author_uid, CASE WHEN bool_and(comment_id IN (SELECT target_id FROM r)) THEN count(*) END AS opinions FROM c GROUP BY 1")
def all_or_nothing(spark, sf):
    """An account's opinions are told only if every candidate was released."""
    done = T.current(B.annotations(spark, sf), KEYS).select(F.col("target_id").alias("comment_id")).distinct().withColumn("_d", F.lit(True))
    c = B.comments(spark, sf).select("author_uid", "comment_id").distinct().join(done, "comment_id", "left")
    return c.groupBy("author_uid").agg(F.when(F.count("_d") == F.count(F.lit(1)), F.count(F.lit(1))).alias("opinions"))


@query("v32_summary_facts", CURRENT + f", u AS (SELECT f.code, aspect, count(*) AS n FROM cur JOIN feeds f USING (feed_id) WHERE relevance = 'relevant' AND aspect <> '' AND {window_sql(D7)} GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY n DESC, aspect) AS r, sum(n) OVER (PARTITION BY code) AS total FROM u) SELECT code, string_agg(aspect || ' ' || CAST(n AS VARCHAR), ', ' ORDER BY r) || ' of ' || CAST(max(total) AS VARCHAR) AS told FROM r WHERE r <= 2 GROUP BY 1")
def summary_facts(spark, sf):
    """Numbers first, words last: the two main aspects of a product's units."""
    feeds = B.feeds(spark, sf).where(C.in_window(F.col("posted_at"), D7)).select("feed_id", "code")
    u = T.current(B.annotations(spark, sf), KEYS).where("relevance = 'relevant' and aspect <> ''").join(feeds, "feed_id").groupBy("code", "aspect").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("code")
    r = u.withColumns({"r": F.row_number().over(w.orderBy(F.desc("n"), "aspect")), "total": F.sum("n").over(w)}).where("r <= 2")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("r", "aspect", "n"))), lambda x: F.concat_ws(" ", x["aspect"], x["n"].cast("string")))
    return r.groupBy("code").agg(F.concat(F.array_join(parts, ", "), F.lit(" of "), F.max("total").cast("string")).alias("told"))


@query("v37_lexicon_recall", "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(toxic, 0) = 0 AND (contains(lower(text), 'idiot') OR contains(lower(text), 'worthless')) ORDER BY doc_id LIMIT 200")
def lexicon_recall(spark, sf):
    """Texts the model did not tag although the lexicon hits: a top-200 report."""
    docs = B.read(spark, sf, "documents").where(F.lower("text").contains("idiot") | F.lower("text").contains("worthless")).select("doc_id")
    return docs.join(B.read(spark, sf, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_anti").orderBy("doc_id").limit(200)


@query("v36_counter_recovery", "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS shares FROM events")
def counter_recovery(spark, sf):
    """Cut documents: the counter counts if its object was closed before the cut."""
    k = F.get_json_object("props", "$.k")
    whole = F.concat(F.lit('{"common": {"share_count": '), k, F.lit('}, "text": "cut he'))
    torn = F.concat(F.lit('{"common": {"share_count": '), k, F.lit(', "text": "cut he'))
    raw = F.when(F.col("event_id") % 3 != 0, whole).otherwise(torn)
    return B.read(spark, sf, "events").select("event_id", R.recovered_counter(raw, ("common.share_count", "share_count")).alias("shares"))


@query("f56_offpool_stocks", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Alpha' WHEN 1 THEN '' WHEN 2 THEN 'Beta' ELSE '' END AS stocks FROM documents")
def offpool_stocks(spark, sf):
    said = F.when(F.col("doc_id") % 4 == 0, "look at alpha today").when(F.col("doc_id") % 4 == 1, "alphabet in 2020").when(F.col("doc_id") % 4 == 2, "00700 or 2020").otherwise("nothing")
    return B.read(spark, sf, "documents").select("doc_id", F.array_join(R.stocks(said, {"alpha": "Alpha", "00700": "Beta", "2020": "Gamma"}), ",").alias("stocks"))


@query("f48_attribution", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'explicit' WHEN 1 THEN 'inferred' ELSE 'unattributed' END AS origin, CASE doc_id % 4 WHEN 0 THEN 'A1' WHEN 1 THEN 'B1' END AS code FROM documents")
def attribution(spark, sf):
    """Named products first; else the issuer's product if it is the only one of the sector; else none."""
    names = {"alpha fund": "A1", "alpha": "", "beta tech": "B1"}
    said = F.when(F.col("doc_id") % 4 == 0, "buy alpha fund now").when(F.col("doc_id") % 4 == 1, "our tech product").when(F.col("doc_id") % 4 == 2, "our bonds").otherwise("hello")
    products = spark.createDataFrame([("A1", "alpha", "cash"), ("B1", "house", "tech"), ("C1", "house", "bonds"), ("C2", "house", "bonds")], "code string, issuer string, sector string")
    only = products.where("issuer = 'house'").groupBy("sector").agg(F.min("code").alias("guess"), F.count(F.lit(1)).alias("n")).where("n = 1").select("sector", "guess")
    rows = B.read(spark, sf, "documents").select("doc_id", said.alias("said"))
    rows = rows.withColumns({"named": F.filter(dictionary.name_codes(F.col("said"), names), lambda c: c != ""), "sector": F.nullif(F.regexp_extract("said", "(tech|bonds)", 1), F.lit(""))}).join(only, "sector", "left")
    explicit = F.when(F.size("named") == 1, F.get("named", F.lit(0)))
    return rows.select("doc_id", F.when(explicit.isNotNull(), "explicit").when(F.col("guess").isNotNull(), "inferred").otherwise("unattributed").alias("origin"), F.coalesce(explicit, "guess").alias("code"))


@query("f58_topic_detail", "SELECT doc_id, CAST(length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS BIGINT) * 3 + CAST(least(length(text), 400) AS BIGINT) AS score, md5(CASE WHEN length(text) > 400 THEN substr(text, 1, 250) || '…' || right(text, 149) ELSE text END) AS cut FROM documents")
def topic_detail(spark, sf):
    """Digits and length make detail; long texts keep head and tail."""
    n = F.length("text")
    digits = n - F.length(F.regexp_replace("text", "[0-9]", ""))
    cut = F.when(n > 400, F.concat(F.substring("text", 1, 250), F.lit("…"), F.expr("right(text, 149)"))).otherwise(F.col("text"))
    return B.read(spark, sf, "documents").select("doc_id", (digits * 3 + F.least(n, F.lit(400))).cast("long").alias("score"), F.md5(cut).alias("cut"))


@query("s10_catalog_script", "SELECT CAST(event_id % 50 AS VARCHAR) AS code, arg_min(CASE WHEN event_id % 3 <> 0 THEN event_type END, event_id) AS name, count(DISTINCT CASE WHEN event_id % 3 <> 0 THEN event_type END) AS name_values FROM events GROUP BY 1")
def catalog_script(spark, sf):
    rows = B.read(spark, sf, "events").select(F.col("event_id").alias("seq"), (F.col("event_id") % 50).cast("string").alias("code"), F.when(F.col("event_id") % 3 != 0, F.col("event_type")).otherwise(" ").alias("name"))
    scripts = rows.select(F.concat(F.lit("cb({\"data\":["), F.to_json(F.struct("seq", "code", "name")), F.lit("]});")).alias("script"))
    return R.merged_catalog(R.jsonp_rows(scripts, "script", "struct<seq:long,code:string,name:string>"), "code", ["name"])


@query("f11_treemap", "SELECT l_returnflag AS grp, l_linestatus || '-' || CAST(l_linenumber AS VARCHAR) AS item, round(10000 * sum(l_quantity) / sum(sum(l_quantity)) OVER (PARTITION BY l_returnflag), 4) AS area FROM lineitem GROUP BY l_returnflag, l_linestatus, l_linenumber")
def treemap(spark, sf):
    g = B.read(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("grp"), F.concat_ws("-", "l_linestatus", F.col("l_linenumber").cast("string")).alias("item")).agg(F.sum("l_quantity").alias("weight"))
    return R.treemap(g, "grp", "item", "weight").select("grp", "item", F.round(F.col("w") * F.col("h"), 4).alias("area"))


@query("v35_backfill_audit", BASE + ", r AS (SELECT feed_id, CASE WHEN source_ticker IS NULL THEN 'unresolved' ELSE 'resolved' END AS s FROM feeds) SELECT count(*) AS rows_, count(*) FILTER (s = 'resolved') AS resolved, count(*) FILTER (s = 'unresolved') AS unresolved, count(*) FILTER (s = 'unresolved') = 0 AS activate FROM r")
def backfill_audit(spark, sf):
    """A backfill is one recomputation; it goes live only if nothing is left unresolved."""
    bad = F.count_if(F.col("source_ticker").isNull())
    return B.feeds(spark, sf).agg(F.count(F.lit(1)).alias("rows_"), F.count("source_ticker").alias("resolved"), bad.alias("unresolved"), (bad == 0).alias("activate"))


@query("t3_t6_cursors", "WITH c AS (SELECT event_type AS stream, max(ts) FILTER (event_id % 2 = 0) AS live, max(ts) FILTER (event_id % 2 = 1) AS backfill FROM events GROUP BY 1) SELECT stream, greatest(live, backfill) AS cursor, CAST(least(CAST(greatest(live, backfill) + INTERVAL 8 HOUR AS DATE), DATE '2024-01-29') AS VARCHAR) AS anchor FROM c")
def cursors(spark, sf):
    """Promotion never moves a live cursor back; the observed anchor is yesterday at most."""
    at = lambda odd: F.max(F.when(F.col("event_id") % 2 == odd, F.col("ts")))
    c = B.read(spark, sf, "events").groupBy(F.col("event_type").alias("stream")).agg(F.greatest(at(0), at(1)).alias("cursor"))
    return c.withColumn("anchor", F.least(C.local_day(F.col("cursor")), F.lit(B.ANCHOR)).cast("string"))


@query("t4_t19_receipts", BASE + ", r AS (SELECT subject_code, CAST(created_at + INTERVAL 8 HOUR AS DATE) AS day, count(*) AS expected, count(*) FILTER (status <> 'dead') AS got FROM jobs GROUP BY 1, 2) SELECT subject_code, CAST(max(CASE WHEN got = expected OR got >= 60 THEN day END) AS VARCHAR) AS watermark, count(*) FILTER (got < expected) AS failed FROM r GROUP BY 1")
def receipts(spark, sf):
    """A run's receipt: what was expected against what arrived; only proved days move the watermark."""
    r = jobs(spark, sf).groupBy("subject_code", C.local_day(F.col("created_at")).alias("day")).agg(F.count(F.lit(1)).alias("expected"), F.count_if(F.col("status") != "dead").alias("got"))
    proved = (F.col("got") == F.col("expected")) | (F.col("got") >= 60)
    return r.groupBy("subject_code").agg(F.max(F.when(proved, F.col("day"))).cast("string").alias("watermark"), F.count_if(F.col("got") < F.col("expected")).alias("failed"))
