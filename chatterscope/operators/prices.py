"""Price bars: daily bars from ticks, resampling with completeness, validation."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The exchange's morning and afternoon sessions as minutes of the local day; between them is the lunch break.
SESSIONS = ((9 * 60 + 30, 12 * 60), (13 * 60, 16 * 60))


def day_bars(ticks: DataFrame) -> DataFrame:
    at = F.col("seq") * 10 + F.col("sub")
    return ticks.groupBy("code", "session_date").agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume")
    )


def resample(bars: DataFrame, first: date, sessions: int) -> DataFrame:
    """Blocks of ``sessions`` days from the first; a block lacking a session has no prices."""
    block = F.floor(F.datediff("session_date", F.lit(first)) / sessions).cast("int")
    out = bars.groupBy("code", block.alias("week")).agg(F.min_by("open", "session_date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "session_date").alias("close"), F.count(F.lit(1)).alias("_n"))
    return out.select("code", "week", *[F.when(F.col("_n") == sessions, F.col(c)).alias(c) for c in ("open", "high", "low", "close")])


def conflicts(bars: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with more than one price: such a delivery fails as a whole."""
    return bars.groupBy(*keys).agg(F.count_distinct("price").alias("_n")).where("_n > 1").drop("_n")


def sound(bars: DataFrame, repair: float = 0.005) -> DataFrame:
    """Positive bars whose envelope holds open and close; one that misses by at most ``repair`` of the price is widened."""
    low, high = F.least("low", "open", "close"), F.greatest("high", "open", "close")
    near = (F.col("low") - low <= repair * F.col("low")) & (high - F.col("high") <= repair * F.col("high"))
    positive = F.least("open", "high", "low", "close") > 0
    return bars.where(positive & near).withColumns({"low": low, "high": high})


def session_slots(days: DataFrame, holidays: tuple[date, ...] = (), sessions: tuple[tuple[int, int], ...] = SESSIONS) -> DataFrame:
    """days: day. day, slot (local time) for each half hour of the sessions; none at weekends and on holidays."""
    minutes = [m for a, b in sessions for m in range(a, b, 30)]
    opened = days.where(F.weekday("day") < 5)
    if holidays:
        opened = opened.where(~F.col("day").isin(list(holidays)))
    at = F.explode(F.array(*map(F.lit, minutes)))
    return opened.select("day", at.alias("_m")).select("day", (F.col("day").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("_m"))).alias("slot"))


def hour_prices(codes: DataFrame, days: DataFrame, slots: DataFrame, bars: DataFrame) -> DataFrame:
    """code, day, hour, open, high, low, close, note for all hours of the days, from bars (code, slot, open, high, low, close).

    An hour has prices if any of its slots has a bar; a bar outside the slots counts for nothing. The note says why there are none.
    """
    hours = days.join(slots.groupBy("day").agg(F.collect_set(F.hour("slot")).alias("_open")), "day", "left").select("day", "_open", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    at = F.col("slot")
    found = bars.join(slots, "slot").groupBy("code", "day", F.hour("slot").alias("hour")).agg(
        F.min_by("open", at).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", at).alias("close")
    )
    out = codes.crossJoin(hours).join(found, ["code", "day", "hour"], "left")
    note = (
        F.when(F.col("close").isNotNull(), "").when(F.col("_open").isNull(), "closed").when(F.array_contains("_open", F.col("hour")), "missing")
        .when(F.col("hour") == 12, "lunch").otherwise("outside")
    )
    return out.select("code", "day", "hour", "open", "high", "low", "close", note.alias("note"))
