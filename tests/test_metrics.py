"""Golden values of the metric expressions."""

import pytest
from pyspark.sql import functions as F

from chatterscope.functions import metrics as M


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def num(x, kind="long"):
    return F.lit(x).cast(kind)


@pytest.mark.parametrize("c,l,s,u,want", [(100, 50, 10, 0, 125), (0, 5, 0, 0, 2), (1, 5, 0, 0, 3), (3, 5, 0, 0, 5), (100, 50, 0, 1, 115), (100, 50, None, 2, 115), (100, 50, None, 0, None), (0, 0, 0, 0, 0), (None, 1, 1, 0, None)])
def test_heat(spark, c, l, s, u, want):
    assert one(spark, M.heat(num(c), num(l), num(s), num(u))) == want


@pytest.mark.parametrize("cur,base,abs_,pct,dir_,short", [(None, 1, None, None, 0, "n/a"), (37, 0, 37, None, 1, "new"), (0, 0, 0, None, 0, "-"), (120, 100, 20, 20.0, 1, "+20%"), (80, 100, -20, -20.0, -1, "-20%"), (1025, 1000, 25, 2.5, 1, "+3%")])
def test_delta(spark, cur, base, abs_, pct, dir_, short):
    a, b = num(cur), num(base)
    assert one(spark, M.delta_abs(a, b)) == abs_
    assert one(spark, M.delta_pct(a, b)) == pct
    assert one(spark, M.delta_dir(a, b)) == dir_
    assert one(spark, M.delta_short(a, b)) == short


@pytest.mark.parametrize("cur,base,want", [(5, None, None), (3, 0, "new"), (0, 0, None), (12, 10, "continuing"), (6, 10, "fading"), (9, 10, "continuing"), (7, 10, "continuing")])
def test_lifecycle(spark, cur, base, want):
    assert one(spark, M.lifecycle(num(cur), num(base))) == want


@pytest.mark.parametrize("share,life,want", [(30, "continuing", "high"), (30, "fading", "medium"), (12, "new", "medium"), (5, "new", "low"), (None, "new", None)])
def test_severity(spark, share, life, want):
    assert one(spark, M.severity(num(share, "double"), F.lit(life))) == want


@pytest.mark.parametrize("p,n,z,want", [(None, 1, 0, None), (0, 0, 0, None), (0, 0, 5, "low_sample"), (5, 4, 0, "low_sample"), (7, 3, 0, "positive"), (6, 5, 0, "neutral_positive"), (5, 5, 9, "neutral"), (3, 9, 0, "negative")])
def test_product_opinion(spark, p, n, z, want):
    assert one(spark, M.product_opinion(num(p), num(n), num(z))) == want


def test_coverage_halves_to_even(spark):
    assert one(spark, M.coverage_ratio(num(1), num(0))) is None
    assert one(spark, M.coverage_ratio(num(3), num(2))) == 1.0
    assert one(spark, M.percent(num(1), num(8))) == 13


def test_null_infectious_sum(spark):
    rows = spark.createDataFrame([("a", 1), ("a", None), ("b", 2)], "k string, v long")
    assert {r.k: r.s for r in rows.groupBy("k").agg(M.null_infectious_sum(F.col("v")).alias("s")).collect()} == {"a": None, "b": 2}
    assert rows.limit(0).agg(M.null_infectious_sum(F.col("v")).alias("s")).first().s == 0
