"""Observation of discussion: qualification, product and bucket grains, zero fill, ranks and deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chatterscope.functions import metrics as M


def source_ticker_valid(ticker: Column, code: Column) -> Column:
    return F.coalesce((F.trim(ticker) != "") & (F.upper(ticker) == F.upper(F.concat(F.lit("0"), code, F.lit(".HK")))), F.lit(False))


def mention_flags(feeds: DataFrame, mentions: DataFrame, excluded: list[str]) -> DataFrame:
    """feed_id, self, excluded: what each post mentions, pre-aggregated so that one join serves all policies."""
    own = feeds.select("feed_id", F.upper(F.concat(F.lit("0"), "code", F.lit(".HK"))).alias("_own"))
    raw = F.upper("raw_ticker")
    return mentions.join(own, "feed_id").groupBy("feed_id").agg(F.bool_or(raw == F.col("_own")).alias("self"), F.bool_or(raw.isin(*[x.upper() for x in excluded])).alias("excluded"))


def qualified(feeds: DataFrame, mentions: DataFrame, policy: dict[str, str], default: str = "exclude", excluded: tuple[str, ...] = ("09999.HK",)) -> DataFrame:
    """Posts that count for their product. ``exact`` needs a self-mention; ``exclude`` takes posts without excluded mentions too."""
    mode = F.lit(default)
    for code, m in policy.items():
        mode = F.when(F.col("code") == code, m).otherwise(mode)
    own, bad = F.coalesce("self", F.lit(False)), F.coalesce("excluded", F.lit(False))
    rule = F.when(mode == "exact", own).otherwise(own | ~bad)
    flagged = feeds.join(mention_flags(feeds, mentions, list(excluded)), "feed_id", "left")
    return flagged.where(source_ticker_valid(F.col("source_ticker"), F.col("code")) & rule).select(feeds.columns)


def qualified_by_semi_joins(feeds: DataFrame, mentions: DataFrame, exact: bool, excluded: tuple[str, ...] = ("09999.HK",)) -> DataFrame:
    """The same by semi joins, as the policies are worded."""
    own = mentions.select("feed_id", F.upper("raw_ticker").alias("_t"))
    named = feeds.where(source_ticker_valid(F.col("source_ticker"), F.col("code"))).withColumn("_own", F.upper(F.concat(F.lit("0"), "code", F.lit(".HK"))))
    with_self = named.join(own, (named["feed_id"] == own["feed_id"]) & (F.col("_own") == F.col("_t")), "left_semi")
    if exact:
        return with_self.select(feeds.columns)
    bad = own.where(F.col("_t").isin(*[x.upper() for x in excluded])).select("feed_id").distinct()
    return with_self.unionByName(named.join(bad, "feed_id", "left_anti").join(with_self.select("feed_id"), "feed_id", "left_anti")).select(feeds.columns)


def reply_sums(comments: DataFrame) -> DataFrame:
    return comments.groupBy("feed_id").agg(F.coalesce(F.sum("like_count"), F.lit(0)).alias("reply_likes"), F.count(F.lit(1)).alias("replies"))


def observe(posts: DataFrame, comments: DataFrame, keys: list[str]) -> DataFrame:
    """One row per keys: mentions, comments, platform_comments, likes, shares, unknown_posts, active, interactions, heat.

    Replies are summed per post before the join; their time is the post's. Distinct accounts and rounded heat do not add
    up, so every grain is observed from posts.
    """
    facts = posts.join(reply_sums(comments), "feed_id", "left").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("mentions"), F.sum("comment_count").alias("platform_comments"),
        (F.coalesce(F.sum("like_count"), F.lit(0)) + F.coalesce(F.sum("reply_likes"), F.lit(0))).alias("likes"),
        F.sum("share_count").alias("shares"), F.count_if(F.col("share_count").isNull()).alias("unknown_posts"),
    )
    named = posts.select("feed_id", *keys)
    authors = posts.select(*keys, "author_uid").unionByName(named.join(comments.select("feed_id", "author_uid"), "feed_id").select(*keys, "author_uid"))
    active = authors.where(F.col("author_uid") != "").groupBy(*keys).agg(F.count_distinct("author_uid").alias("active"))
    out = facts.join(active, keys, "left").withColumn("active", F.coalesce("active", F.lit(0)))
    shares = F.coalesce("shares", F.lit(0))
    return out.select(
        *keys, "mentions", F.col("mentions").alias("comments"), "platform_comments", "likes", shares.alias("shares"), "unknown_posts", "active",
        (F.col("likes") + shares).alias("interactions"), M.heat(F.col("mentions"), F.col("likes"), F.col("shares"), F.col("unknown_posts")).alias("heat"),
    )


COUNTS = ["mentions", "comments", "platform_comments", "likes", "shares", "unknown_posts", "active", "interactions", "heat"]


def zero_filled(products: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    return products.join(observed, keys, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in COUNTS if c in observed.columns})


def ranked(rows: DataFrame, by: str, tie: str = "code", name: str = "rank") -> DataFrame:
    """Whole-market rank, a total order. One row a product, so the one-partition sort is over a dimension."""
    return rows.withColumn(name, F.row_number().over(W.orderBy(F.desc(by), tie)))


def with_baseline(cur: DataFrame, base: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return deltas(cur.join(base.select(key, *[F.col(c).alias(f"base_{c}") for c in columns]), key, "left"), columns)


def deltas(out: DataFrame, columns: list[str]) -> DataFrame:
    """Add abs, pct and dir of each column against its ``base_`` twin."""
    for c in columns:
        a, b = F.col(c), F.col(f"base_{c}")
        out = out.withColumns({f"{c}_abs": M.delta_abs(a, b), f"{c}_pct": F.round(M.delta_pct(a, b), 6), f"{c}_dir": M.delta_dir(a, b)})
    return out


def side_by_side(observed: DataFrame, key: str, period: str, columns: list[str]) -> DataFrame:
    """Rows of (key, period) with period cur or base as one row a key: one scan serves both periods."""
    at = lambda p, c: F.max(F.when(F.col(period) == p, F.col(c)))
    return observed.groupBy(key).agg(*[at("cur", c).alias(c) for c in columns], *[at("base", c).alias(f"base_{c}") for c in columns])


def head_and_rest(rows: DataFrame, value: str, head: int, name: str = "code") -> DataFrame:
    """The ``head`` largest positive rows, and one row ``other`` for the sum of the rest."""
    place = F.row_number().over(W.orderBy(F.desc(value), name))
    cut = rows.withColumn("_r", place).withColumn("item", F.when((F.col("_r") <= head) & (F.col(value) > 0), F.col(name)).otherwise("other"))
    return cut.groupBy("item").agg(F.sum(value).alias(value), F.count(F.lit(1)).alias("members"))


def daily_spine(spark, first, days: int, name: str = "day") -> DataFrame:
    return spark.range(days).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias(name))
