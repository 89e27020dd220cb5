"""The audit report in full, for everything and for a scope; views over raw rows of one snapshot."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from chatterscope.operators import audit as A
from chatterscope.plans.catalog import query
from chatterscope.plans.opinions import CURRENT, JOBS, KEYS, jobs
from chatterscope.sources import bindings as B
from chatterscope.sources import views as V

KINDS = ("attitude", "relevance", "compliance", "text_quality")
#: The events as jobs, runs of a user each, and four kinds of annotation a row. {s} cuts a scope of units out of jobs and annotations.
AUDIT = (
    CURRENT
    + f""", {JOBS}, jb AS (SELECT j.*, 'no answer for user ' || CAST(user_id AS VARCHAR) AS last_error FROM jobs j JOIN ev ON event_id = job_id {{s}}),
un AS (SELECT a.*, CAST(user_id AS VARCHAR) AS run_id FROM annotations a JOIN ev ON event_id = annotation_id {{s}}),
cu AS (SELECT * FROM cur {{s}}),
rn AS (SELECT CAST(user_id AS VARCHAR) AS run_id, min(event_type) AS task, CASE WHEN user_id % 3 = 0 THEN 'rule' ELSE 'llm' END AS provider, max(ts) AS started_at, count(*) AS input_count, count(*) FILTER (k % 5 > 1) AS success_count, count(*) FILTER (k % 5 = 1) AS error_count,
  CASE WHEN user_id % 4 <> 0 THEN sum(k) END AS token_input, sum(k % 100) AS token_output, CASE WHEN user_id % 5 <> 0 THEN sum(k % 7) END AS token_reasoning FROM ev GROUP BY user_id),
lr AS (SELECT *, token_input IS NULL AND provider <> 'rule' AS unknown FROM rn {{r}} ORDER BY started_at DESC, run_id DESC LIMIT 50),
us AS (SELECT task, count(*) AS runs, count(*) FILTER (unknown) AS unknown_usage_runs, sum(input_count) AS input_count, sum(success_count) AS success_count, sum(error_count) AS error_count,
  sum(CASE WHEN unknown THEN 0 ELSE coalesce(token_input, 0) END) AS token_input, sum(CASE WHEN unknown THEN 0 ELSE token_output END) AS token_output, sum(CASE WHEN unknown THEN 0 ELSE coalesce(token_reasoning, 0) END) AS token_reasoning FROM lr GROUP BY 1),
top AS (SELECT subject_code FROM cu WHERE relevance = 'relevant' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 40),
rel AS (SELECT annotation_id FROM un WHERE relevance = 'relevant'),
tags AS (SELECT unnest(CASE WHEN market = 'none' THEN [] WHEN attitude = 'negative' THEN [market, 'doubt'] ELSE [market] END) AS tag FROM cu),
out AS (SELECT 'queue' AS section, subject_code AS name, status AS measure, CAST(count(*) AS DOUBLE) AS value FROM jb GROUP BY 2, 3
 UNION ALL SELECT 'queue', subject_code, 'completion', round_even(CAST(count(*) FILTER (status = 'done') AS DOUBLE) / count(*), 4) FROM jb GROUP BY 2
 UNION ALL (SELECT 'dead letters', last_error, 'jobs', count(*) FROM jb WHERE status = 'dead' GROUP BY 2 ORDER BY 4 DESC, 2 LIMIT 5)
 UNION ALL SELECT 'usage', task, measure, CAST(v AS DOUBLE) FROM us UNPIVOT (v FOR measure IN (runs, unknown_usage_runs, input_count, success_count, error_count, token_input, token_output, token_reasoning))
 UNION ALL SELECT 'annotations', 'all', 'rows', count(*) * 4 FROM un
 UNION ALL SELECT 'annotations', 'all', 'rule_rows', count(*) FILTER (provider = 'rule') * 4 FROM un
 UNION ALL SELECT 'annotations', 'all', 'needs_review_rate', round_even(CAST(count(*) FILTER (review_state = 'pending') AS DOUBLE) / greatest(count(*), 1), 4) FROM un
 UNION ALL SELECT 'annotations', 'review_state', CASE review_state WHEN 'pending' THEN 'needs_review' ELSE review_state END, count(*) * 4 FROM un GROUP BY 3
 UNION ALL SELECT 'annotations', 'kind', kind, count(*) FROM un, (SELECT unnest({list(KINDS)}) AS kind) GROUP BY 3
 UNION ALL SELECT 'annotations', 'all', 'evidence_located_rate', round_even(CAST(count(c.comment_id) AS DOUBLE) / count(*), 4) FROM rel LEFT JOIN (SELECT comment_id FROM (SELECT event_id AS comment_id FROM ev WHERE event_id % 4 <> 0 AND k % 9 <> 0)) c ON c.comment_id = rel.annotation_id
 UNION ALL SELECT 'prefilter', 'rule', CASE WHEN aspect = '' THEN 'unknown' ELSE aspect END, count(*) FROM un GROUP BY 3
 UNION ALL SELECT 'attitudes', subject_code, attitude, count(*) FROM cu SEMI JOIN top USING (subject_code) WHERE relevance = 'relevant' GROUP BY 2, 3
 UNION ALL SELECT 'attitudes', subject_code, 'irrelevant', count(*) FILTER (relevance = 'irrelevant') FROM cu SEMI JOIN top USING (subject_code) GROUP BY 2
 UNION ALL SELECT 'attitudes', subject_code, 'needs_context', 0 FROM top
 UNION ALL SELECT 'compliance', 'all', 'scanned_units', count(*) FROM cu
 UNION ALL SELECT 'compliance', 'tags', tag, count(*) FROM tags GROUP BY 3)
SELECT section, name, measure, value FROM out"""
)


def audited(spark, sf, scope=None):
    e = B._events(spark, sf)
    user, k = F.col("user_id"), F.col("k")
    work = jobs(spark, sf).withColumnRenamed("subject_code", "task").withColumn("subject_code", F.col("task"))
    work = work.join(e.select(F.col("event_id").alias("job_id"), F.concat(F.lit("no answer for user "), user.cast("string")).alias("last_error")), "job_id")
    runs = e.groupBy("user_id").agg(
        F.min("event_type").alias("task"), F.max("ts").alias("started_at"), F.count(F.lit(1)).alias("input_count"), F.count_if(k % 5 > 1).alias("success_count"), F.count_if(k % 5 == 1).alias("error_count"),
        F.sum("k").alias("_in"), F.sum(k % 100).alias("token_output"), F.sum(k % 7).alias("_reason"),
    )
    runs = runs.withColumns({"run_id": user.cast("string"), "provider": F.when(user % 3 == 0, "rule").otherwise("llm"), "token_input": F.when(user % 4 != 0, F.col("_in")), "token_reasoning": F.when(user % 5 != 0, F.col("_reason"))})
    a = B.annotations(spark, sf).join(e.select(F.col("event_id").alias("annotation_id"), user.cast("string").alias("run_id")), "annotation_id")
    tags = F.when(F.col("market") == "none", F.array().cast("array<string>")).when(F.col("attitude") == "negative", F.array("market", F.lit("doubt"))).otherwise(F.array("market"))
    values = {"attitude": F.col("attitude"), "relevance": F.col("relevance"), "compliance": F.lit(None).cast("string"), "text_quality": F.when(F.col("aspect") != "", F.col("aspect"))}
    kinds = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("kind"), v.alias("value"), (tags if n == "compliance" else F.lit(None).cast("array<string>")).alias("tags")) for i, (n, v) in enumerate(values.items())]))
    log = a.withColumn("_k", kinds).select(
        (F.col("annotation_id") * 4 + F.col("_k.i")).alias("annotation_id"), *KEYS, "_k.kind", "_k.value", "_k.tags", "created_at", "provider", "run_id", (F.col("supersedes_id") * 4 + F.col("_k.i")).alias("supersedes_id"),
        F.when(F.col("review_state") == "pending", "needs_review").otherwise(F.col("review_state")).alias("review_state"),
    )
    evidence = B.comments(spark, sf).where("like_count is not null").select((F.col("comment_id") * 4 + 1).alias("annotation_id"))
    return A.report(work, runs, log, evidence, KEYS, "subject_code", scope)


@query("a30_full_audit", AUDIT.replace("{s}", "").replace("{r}", ""))
def full_audit(spark, sf):
    """Queue, dead letters, usage of the last runs, states, evidence, attitudes of the leading products and tags."""
    return audited(spark, sf)


@query("a30_scope_audit", AUDIT.replace("{s}", "WHERE target_id % 10 < 3 AND subject_code <> 'view'").replace("{r}", "WHERE run_id IN (SELECT run_id FROM un)"))
def scope_audit(spark, sf):
    """The same of a scope of units; its runs are those that have rows in it, at their whole cost."""
    e = B._events(spark, sf)
    units = e.select(F.explode(F.array("event_id", F.col("event_id") - 2, F.col("event_id") - 1)).alias("target_id"), F.col("event_type").alias("subject_code"))
    return audited(spark, sf, units.where("target_id % 10 < 3 and subject_code <> 'view'"))


@query("s9_snapshot_views", B.ctes() + ", f AS (SELECT event_id AS feed_id, event_type AS code, k FROM ev WHERE event_id % 4 = 0 AND ts >= TIMESTAMP '2024-01-05 00:00:00'), c AS (SELECT event_id - event_id % 4 AS feed_id, user_id FROM ev WHERE event_id % 4 <> 0 AND ts >= TIMESTAMP '2024-01-05 00:00:00') SELECT code, count(*) AS posts, CAST(sum(k) AS BIGINT) AS k, CAST(sum(coalesce(n, 0)) AS BIGINT) AS replies, CAST(0 AS BIGINT) AS titled FROM f LEFT JOIN (SELECT feed_id, count(*) AS n FROM c GROUP BY 1) USING (feed_id) GROUP BY code")
def snapshot_views(spark, sf):
    """Posts and replies as views over the raw events from a day on, read in one snapshot; a title that the source lacks is unknown."""
    raw = V.Bound(spark, f"{sf}/events.parquet", required=("event_id", "ts"), time="ts", since=datetime(2024, 1, 5))
    raw.view("feeds", {"feed_id": ("event_id", "long"), "code": ("event_type", "string"), "k": ("get_json_object(props, '$.k')", "long"), "title": ("feed_title", "string")}, "event_id % 4 = 0")
    raw.view("comments", {"feed_id": ("event_id - event_id % 4", "long"), "author_uid": ("user_id", "string")}, "event_id % 4 != 0")
    rows = raw.sql("with n as (select feed_id, count(*) as n from {comments} group by feed_id) select code, count(*) as posts, sum(k) as k, sum(coalesce(n, 0)) as replies, count(title) as titled from {feeds} left join n using (feed_id) group by code")
    return raw.table(rows, "snapshot")
