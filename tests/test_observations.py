"""The golden mini-dataset: two products, four posts, four replies on local days 24 and 25 August."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from chatterscope.functions import calendar as C
from chatterscope.operators import facts as T
from chatterscope.operators import observations as O

ANCHOR = date(2026, 8, 25)


def at(day, hour):
    return datetime(2026, 8, day, hour) - C.OFFSET


@pytest.fixture(scope="module")
def world(spark):
    feeds = spark.createDataFrame(
        [(1, "3033", "03033.HK", at(25, 9), "u1", 10, 4, 2), (2, "3033", "03033.HK", at(25, 9), "u2", 0, 1, None), (3, "3032", "03032.HK", at(25, 14), "u3", 5, 2, 0), (4, "3033", "03033.HK", at(24, 11), "u4", 100, 10, 1)],
        "feed_id long, code string, source_ticker string, posted_at timestamp_ntz, author_uid string, like_count long, comment_count long, share_count long",
    )
    comments = spark.createDataFrame([(11, 1, "u9", 3), (12, 1, "u1", 0), (13, 3, "u9", 1), (14, 4, "u4", 0)], "comment_id long, feed_id long, author_uid string, like_count long")
    mentions = spark.createDataFrame([(1, "03033.HK"), (1, "03032.HK"), (2, "03033.hk"), (3, "03032.HK"), (4, "03033.HK")], "feed_id long, raw_ticker string")
    return feeds, comments, mentions


def rows(world, r, keys):
    feeds, comments, mentions = world
    q = O.qualified(feeds.where(C.in_window(F.col("posted_at"), r)), mentions, {}, default="exact")
    return O.observe(q.withColumn("bucket", C.bucket(F.col("posted_at"), r)), comments, keys)


def test_product_grain(world):
    got = {r.code: r for r in rows(world, C.build_range("d1", ANCHOR), ["code"]).collect()}
    own, peer = got["3033"], got["3032"]
    assert (own.mentions, own.comments, own.likes, own.active, own.unknown_posts) == (2, 2, 13, 3, 1)
    assert (peer.mentions, peer.comments, peer.heat, peer.interactions) == (1, 1, 3, 6)


def test_bucket_grain(world):
    got = {r.bucket: r for r in rows(world, C.build_range("d1", ANCHOR), ["code", "bucket"]).where("code = '3033'").collect()}
    assert list(got) == [9] and (got[9].mentions, got[9].heat, got[9].unknown_posts) == (2, 8, 1)


def test_delta_to_baseline(spark, world):
    r = C.build_range("d1", ANCHOR)
    out = O.with_baseline(rows(world, r, ["code"]), rows(world, r.baseline(), ["code"]), "code", ["comments", "heat"]).where("code = '3033'").first()
    assert (out.comments_abs, out.comments_pct, out.heat_abs) == (1, 100.0, -24)


def test_zero_fill_and_rank(spark, world):
    products = spark.createDataFrame([("3033",), ("3032",), ("0001",), ("9999",)], "code string")
    out = O.ranked(O.zero_filled(products, rows(world, C.build_range("d1", ANCHOR), ["code"]), ["code"]), "mentions")
    assert [(r.code, r.mentions) for r in out.orderBy("rank").collect()] == [("3033", 2), ("3032", 1), ("0001", 0), ("9999", 0)]


def test_both_qualifications_agree(world):
    feeds, _, mentions = world
    a = O.qualified(feeds, mentions, {}, default="exclude", excluded=("03032.HK",))
    b = O.qualified_by_semi_joins(feeds, mentions, exact=False, excluded=("03032.HK",))
    assert sorted(r.feed_id for r in a.collect()) == sorted(r.feed_id for r in b.collect()) == [1, 2, 3, 4]


def test_filter_reaches_the_scan(spark, sf):
    from chatterscope.sources import bindings as B

    df = B.read(spark, sf, "events").where(C.in_window(F.col("ts"), C.build_range("d1", B.ANCHOR))).select("event_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan


@pytest.mark.parametrize("key,days,grain,buckets", [("d1", 1, "hour", 24), ("d2", 2, "hour", 48), ("d7", 7, "day", 7), ("d30", 30, "week", 5), ("mtd", 25, "week", 4), ("custom:2026-08-01:2026-08-14", 14, "day", 14)])
def test_ranges(key, days, grain, buckets):
    r = C.build_range(key, ANCHOR)
    assert (r.days, r.grain, r.buckets) == (days, grain, buckets)
    assert r.baseline().days == days and r.baseline().last < r.first


@pytest.mark.parametrize("key", ["d3", "custom:2026-01-01:2026-03-01", "custom:2026-03-02:2026-03-01"])
def test_bad_ranges(key):
    with pytest.raises(ValueError):
        C.build_range(key, ANCHOR)


def reference_stages(cats, days):
    """Unit by unit, as the rule is worded."""
    out = []
    for i, c in enumerate(cats):
        if c is None:
            if out:
                out[-1][1].append(i)
            else:
                out.append([None, [i]])
        elif out and (out[-1][0] in (None, c)):
            out[-1][0] = c
            out[-1][1].append(i)
        else:
            out.append([c, [i]])
    if days >= 14:
        merged = []
        for c, units in out:
            if merged and merged[-1][0] and sum(cats[i] is not None for i in units) <= 1:
                merged[-1][1].extend(units)
            else:
                merged.append([c, list(units)])
        out = merged
    return [(i, n + 1) for n, (_, units) in enumerate(out) for i in units]


@pytest.mark.parametrize("days", [7, 14])
def test_stages(spark, days):
    import random

    rng = random.Random(4)
    series = [[rng.choice([None, "a", "a", "b", "c"]) for _ in range(rng.randint(1, 14))] for _ in range(120)]
    df = spark.createDataFrame([(k, i, c) for k, s in enumerate(series) for i, c in enumerate(s)], "k int, i int, cat string")
    got = {}
    for r in T.stages(df, ["k"], days, False).collect():
        got.setdefault(r.k, []).append((r.i, r.stage))
    for k, s in enumerate(series):
        assert sorted(got[k]) == sorted(reference_stages(s, days)), s
