"""Metric expressions. Unknown (null) is never zero; every function says what null gives."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW_SAMPLE = 10
NET_THRESHOLD = 0.12


def heat(comments: Column, likes: Column, shares: Column, unknown: Column | None = None) -> Column:
    """floor(comments + 0.3 likes + shares + 0.5); unknown shares count as 0 only where unknown posts are disclosed."""
    unknown = F.lit(0) if unknown is None else unknown
    known = F.when(shares.isNotNull(), shares).when(unknown > 0, F.lit(0))
    # tenths in whole numbers: 0.3 has no exact double
    return F.floor((comments * 10 + likes * 3 + known * 10 + 5) / F.lit(10.0)).cast("long")


def delta_abs(cur: Column, base: Column) -> Column:
    return F.when(cur.isNotNull() & base.isNotNull(), F.when((base == 0) & (cur <= 0), F.lit(0)).otherwise(cur - base))


def delta_pct(cur: Column, base: Column) -> Column:
    """Percent of the base; null on a zero base."""
    return F.when(base != 0, (cur - base).cast("double") / base * 100)


def delta_dir(cur: Column, base: Column) -> Column:
    return F.coalesce(F.when((base == 0) & (cur <= 0), 0).otherwise(F.signum((cur - base).cast("double")).cast("int")), F.lit(0))


def delta_short(cur: Column, base: Column) -> Column:
    """Short text: percent without digits, ``new`` on a zero base, a dash for no change from zero, ``n/a`` if unknown."""
    pct = F.round(delta_pct(cur, base).cast("decimal(28,10)"), 0).cast("long")
    told = F.concat(F.when(delta_pct(cur, base) >= 0, "+").otherwise(F.when(pct == 0, "-").otherwise("")), pct.cast("string"), F.lit("%"))
    return F.when(cur.isNull() | base.isNull(), "n/a").when((base == 0) & (cur > 0), "new").when(base == 0, "-").otherwise(told)


def null_infectious_sum(c: Column) -> Column:
    """Null if any value is; 0 over no rows."""
    return F.when(F.count(F.lit(1)) == F.count(c), F.coalesce(F.sum(c), F.lit(0)))


def lifecycle(cur: Column, base: Column) -> Column:
    return (
        F.when(cur.isNull() | base.isNull(), F.lit(None).cast("string"))
        .when(base == 0, F.when(cur > 0, "new"))
        .when(cur * 10 < base * 7, "fading")
        .otherwise("continuing")
    )


def severity(share: Column, life: Column) -> Column:
    return F.when(share.isNull(), F.lit(None).cast("string")).when((share >= 25) & ~life.eqNullSafe("fading"), "high").when(share >= 12, "medium").otherwise("low")


def sample_sufficient(positive: Column, negative: Column) -> Column:
    return positive + negative >= LOW_SAMPLE


def product_opinion(p: Column, n: Column, neutral: Column) -> Column:
    """Five levels without neutral in the denominator; low_sample under ten; null without any analysed row."""
    margin, total = p - n, p + n
    return (
        F.when(p.isNull() | n.isNull() | (total + F.coalesce(neutral, F.lit(0)) == 0), F.lit(None).cast("string"))
        .when(total < LOW_SAMPLE, "low_sample")
        .when(margin > 0, F.when(margin * 4 >= total, "positive").otherwise("neutral_positive"))
        .when(margin < 0, F.when(-margin * 4 >= total, "negative").otherwise("neutral_negative"))
        .otherwise("neutral")
    )


def market_sentiment(p: Column, n: Column, neutral: Column) -> Column:
    margin, total = p - n, p + n + neutral
    return (
        F.when(total.isNull() | (total <= 0), F.lit(None).cast("string"))
        .when(margin > 0, F.when(margin * 4 >= total, "bullish").otherwise("neutral_bullish"))
        .when(margin < 0, F.when(-margin * 4 >= total, "bearish").otherwise("neutral_bearish"))
        .otherwise("neutral")
    )


def net_tone(p: Column, n: Column, half_day: bool = False) -> Column:
    """positive / negative / neutral by the net share; null under the sample threshold."""
    valid = p + n
    threshold = -(-LOW_SAMPLE // 2) if half_day else LOW_SAMPLE
    net = F.try_divide((p - n).cast("double"), valid)
    return F.when(valid < threshold, F.lit(None).cast("string")).when(net > NET_THRESHOLD, "positive").when(net < -NET_THRESHOLD, "negative").otherwise("neutral")


def coverage_ratio(a: Column, b: Column) -> Column:
    """min(1, a/b) to 4 digits, halves to even; null unless b > 0."""
    return F.when(b > 0, F.bround(F.least(F.lit(1.0), a.cast("double") / b), 4))


def percent(n: Column, total: Column) -> Column:
    return F.when(total != 0, F.floor(n.cast("double") / total * 100 + 0.5).cast("long"))


def hue_step(v: Column, peak: Column) -> Column:
    return F.when((v <= 0) | (peak <= 0), 0).otherwise(F.greatest(F.lit(1), F.least(F.lit(5), F.ceil(v.cast("double") / peak * 5)))).cast("int")


def token_estimate(text: Column) -> Column:
    ascii_ = F.length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))
    return F.ceil(((F.length(text) - ascii_) * 1.6 + ascii_ * 0.34) * 1.15).cast("long")


def new_listing(listed: Column, day: Column, days: int) -> Column:
    age = F.datediff(day, listed)
    return (age >= 0) & (age < days)


def recency_priority(age_days: Column, same_month: Column, own: Column, current: Column) -> Column:
    band = F.when(age_days <= 7, 30).when(age_days <= 14, 20).when((age_days <= 30) | same_month, 10).otherwise(0)
    return band + F.when(own, 2).otherwise(0) + F.when(current, 1).otherwise(0)
