"""The domain's relations as projections of the driver's tables, and the same projections as DuckDB text.

Posts are the events whose id divides by four; the three after each are its replies. k is the event's own number.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ANCHOR = date(2024, 1, 29)
OWN = ("click", "purchase", "view")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))


def feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return _events(spark, sf_dir).where("event_id % 4 = 0").select(
        F.col("event_id").alias("feed_id"), F.col("event_type").alias("code"), F.col("ts").alias("posted_at"), F.col("user_id").cast("string").alias("author_uid"),
        F.floor("value").cast("long").alias("like_count"), (k % 6).alias("comment_count"), F.when(k % 10 != 0, k % 7).alias("share_count"),
        F.when(k % 4 != 0, k * 11).alias("browse_count"), F.when(k % 17 != 0, F.concat(F.lit("0"), "event_type", F.lit(".HK"))).alias("source_ticker"), k.alias("k"),
    )


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).where("event_id % 4 != 0").select(
        F.col("event_id").alias("comment_id"), (F.col("event_id") - F.col("event_id") % 4).alias("feed_id"), F.col("ts").alias("commented_at"), F.col("user_id").cast("string").alias("author_uid"),
        F.when(F.col("k") % 9 != 0, F.floor(F.col("value") / 10).cast("long")).alias("like_count"), F.when(F.col("event_id") % 4 > 1, F.col("event_id") - 1).alias("reply_to"), F.col("event_type").alias("said_code"), "k",
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dimension: one row a product."""
    code = F.col("code")
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("code")).distinct().select(
        "code", F.when(code.isin(*OWN), "own").otherwise("peer").alias("ownership"), F.when(code.isin("click", "view", "error"), "traffic").otherwise("money").alias("sector"),
        F.when(code.isin("view", "click"), "long").otherwise("short").alias("struct"), F.date_add(F.lit(date(2024, 1, 1)), F.length("code") * 4).alias("listing_date"),
    )


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Post mentions of tickers: itself unless k divides by 3, a foreign one if it divides by 5."""
    f = feeds(spark, sf_dir)
    own = f.where("k % 3 != 0").select("feed_id", F.concat(F.lit("0"), "code", F.lit(".hk")).alias("raw_ticker"), (F.col("k") % 3).alias("occurrences"))
    other = f.where("k % 5 = 0").select("feed_id", F.lit("09999.HK").alias("raw_ticker"), F.lit(1).cast("long").alias("occurrences"))
    return own.unionByName(other)


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A versioned log of labels on replies: attitude, relevance and aspect; every eleventh row supersedes an earlier one."""
    e = _events(spark, sf_dir).where("event_id % 4 != 0")
    k = F.col("k")
    return e.select(
        F.col("event_id").alias("annotation_id"), (F.col("event_id") - F.when(F.col("event_id") % 8 == 5, 2).otherwise(0)).alias("target_id"), (F.col("event_id") - F.col("event_id") % 4).alias("feed_id"), F.col("event_type").alias("subject_code"),
        F.when(k % 3 == 0, "positive").when(k % 3 == 1, "negative").otherwise("neutral").alias("attitude"), F.when(k % 5 == 0, "irrelevant").otherwise("relevant").alias("relevance"),
        F.when(k % 13 == 0, "").otherwise(F.concat(F.lit("aspect"), (k % 6).cast("string"))).alias("aspect"), F.when(k % 4 == 0, "bullish").when(k % 4 == 1, "bearish").otherwise("none").alias("market"),
        F.when(k % 19 == 0, "rejected").when(k % 7 == 0, "approved").when(k % 7 == 1, "corrected").otherwise("pending").alias("review_state"), F.col("ts").alias("created_at"),
        F.when(k % 11 == 0, F.col("event_id") - 4).alias("supersedes_id"), F.when(k % 2 == 0, "llm").otherwise("rule").alias("provider"), F.concat(F.lit("p"), (k % 3).cast("string")).alias("prompt_version"),
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks: a line item's price at its ship day, for the part's last digit as the code."""
    return read(spark, sf_dir, "lineitem").select(
        (F.col("l_partkey") % 10).cast("string").alias("code"), F.col("l_shipdate").cast("date").alias("session_date"), F.col("l_orderkey").alias("seq"), F.col("l_linenumber").alias("sub"),
        (F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 10000) / F.lit(10000.0)).alias("price"), F.col("l_quantity").cast("long").alias("volume"),
    )


#: The same relations for DuckDB.
SQL_EVENTS = "ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"
SQL_FEEDS = """feeds AS (SELECT event_id AS feed_id, event_type AS code, ts AS posted_at, CAST(user_id AS VARCHAR) AS author_uid, CAST(floor(value) AS BIGINT) AS like_count,
 k % 6 AS comment_count, CASE WHEN k % 10 <> 0 THEN k % 7 END AS share_count, CASE WHEN k % 4 <> 0 THEN k * 11 END AS browse_count,
 CASE WHEN k % 17 <> 0 THEN '0' || event_type || '.HK' END AS source_ticker, k FROM ev WHERE event_id % 4 = 0)"""
SQL_COMMENTS = """comments AS (SELECT event_id AS comment_id, event_id - event_id % 4 AS feed_id, ts AS commented_at, CAST(user_id AS VARCHAR) AS author_uid,
 CASE WHEN k % 9 <> 0 THEN CAST(floor(value / 10) AS BIGINT) END AS like_count, CASE WHEN event_id % 4 > 1 THEN event_id - 1 END AS reply_to, event_type AS said_code, k FROM ev WHERE event_id % 4 <> 0)"""
SQL_PRODUCTS = """products AS (SELECT code, CASE WHEN code IN ('click','purchase','view') THEN 'own' ELSE 'peer' END AS ownership, CASE WHEN code IN ('click','view','error') THEN 'traffic' ELSE 'money' END AS sector,
 CASE WHEN code IN ('view','click') THEN 'long' ELSE 'short' END AS struct, DATE '2024-01-01' + CAST(length(code) * 4 AS INTEGER) AS listing_date FROM (SELECT DISTINCT event_type AS code FROM events))"""
SQL_MENTIONS = """mentions AS (SELECT feed_id, '0' || code || '.hk' AS raw_ticker, k % 3 AS occurrences FROM feeds WHERE k % 3 <> 0
 UNION ALL SELECT feed_id, '09999.HK', 1 FROM feeds WHERE k % 5 = 0)"""
SQL_ANNOTATIONS = """annotations AS (SELECT event_id AS annotation_id, event_id - CASE WHEN event_id % 8 = 5 THEN 2 ELSE 0 END AS target_id, event_id - event_id % 4 AS feed_id, event_type AS subject_code,
 CASE k % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'neutral' END AS attitude, CASE WHEN k % 5 = 0 THEN 'irrelevant' ELSE 'relevant' END AS relevance,
 CASE WHEN k % 13 = 0 THEN '' ELSE 'aspect' || CAST(k % 6 AS VARCHAR) END AS aspect, CASE k % 4 WHEN 0 THEN 'bullish' WHEN 1 THEN 'bearish' ELSE 'none' END AS market,
 CASE WHEN k % 19 = 0 THEN 'rejected' WHEN k % 7 = 0 THEN 'approved' WHEN k % 7 = 1 THEN 'corrected' ELSE 'pending' END AS review_state, ts AS created_at,
 CASE WHEN k % 11 = 0 THEN event_id - 4 END AS supersedes_id, CASE WHEN k % 2 = 0 THEN 'llm' ELSE 'rule' END AS provider, 'p' || CAST(k % 3 AS VARCHAR) AS prompt_version FROM ev WHERE event_id % 4 <> 0)"""
SQL_BARS = """bars AS (SELECT CAST(l_partkey % 10 AS VARCHAR) AS code, CAST(l_shipdate AS DATE) AS session_date, l_orderkey AS seq, l_linenumber AS sub,
 floor(l_extendedprice / l_quantity * 10000) / CAST(10000 AS DOUBLE) AS price, CAST(l_quantity AS BIGINT) AS volume FROM lineitem)"""


def ctes(*names: str) -> str:
    """WITH text of the named relations and what they need."""
    known = {"feeds": SQL_FEEDS, "comments": SQL_COMMENTS, "products": SQL_PRODUCTS, "mentions": SQL_MENTIONS, "annotations": SQL_ANNOTATIONS, "bars": SQL_BARS}
    need = ["feeds", *names] if "mentions" in names else list(names)
    return "WITH " + ", ".join([SQL_EVENTS, *[known[n] for n in dict.fromkeys(need)]])
