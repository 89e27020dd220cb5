"""Business days are Hong Kong days over UTC-naive storage; windows are half-open. Ranges are small and made on the driver."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Asia/Hong_Kong"
OFFSET = timedelta(hours=8)
PRESETS = {"d0": 1, "d1": 1, "d2": 2, "d7": 7, "d14": 14, "d30": 30}
MARKET_MAX_DAYS = 31


@dataclass(frozen=True)
class Range:
    """First and last local day; buckets are hours (up to 2 days), days (up to 14) or 7-day blocks from the first day."""

    first: date
    last: date

    @property
    def days(self) -> int:
        return (self.last - self.first).days + 1

    @property
    def grain(self) -> str:
        return "hour" if self.days <= 2 else "day" if self.days <= 14 else "week"

    @property
    def buckets(self) -> int:
        return {"hour": self.days * 24, "day": self.days, "week": -(-self.days // 7)}[self.grain]

    def baseline(self) -> Range:
        return Range(self.first - timedelta(days=self.days), self.first - timedelta(days=1))


def build_range(key: str, anchor: date) -> Range:
    """A preset ends at the anchor day (d0 is the day after it), mtd begins with its month, custom:a:b is as given."""
    if key.startswith("custom:"):
        _, a, b = key.split(":")
        out = Range(date.fromisoformat(a), date.fromisoformat(b))
        if out.days < 1 or out.days > MARKET_MAX_DAYS:
            raise ValueError(f"a custom range has 1 to {MARKET_MAX_DAYS} days: {key}")
        return out
    if key == "mtd":
        return Range(anchor.replace(day=1), anchor)
    if key not in PRESETS:
        raise ValueError(f"unknown range: {key}")
    last = anchor + timedelta(days=1) if key == "d0" else anchor
    return Range(last - timedelta(days=PRESETS[key] - 1), last)


def utc_bounds(r: Range, through: datetime | None = None) -> tuple[datetime, datetime]:
    """[from, to) in UTC; a partial day ends one microsecond after the last data."""
    lo = datetime.combine(r.first, datetime.min.time()) - OFFSET
    hi = datetime.combine(r.last + timedelta(days=1), datetime.min.time()) - OFFSET
    return lo, hi if through is None else min(hi, through + timedelta(microseconds=1))


def in_window(ts: Column, r: Range, through: datetime | None = None) -> Column:
    """A literal range on the stored column, so that it reaches the Parquet scan."""
    lo, hi = utc_bounds(r, through)
    return (ts >= F.lit(lo.isoformat(sep=" ")).cast("timestamp_ntz")) & (ts < F.lit(hi.isoformat(sep=" ")).cast("timestamp_ntz"))


def local(ts: Column) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(ZONE), ts)


def local_day(ts: Column) -> Column:
    return local(ts).cast("date")


def bucket(ts: Column, r: Range) -> Column:
    """Index of the range's bucket; weeks count from the range's first day."""
    days = F.datediff(local_day(ts), F.lit(r.first))
    if r.grain == "hour":
        return (days * 24 + F.hour(local(ts))).cast("int")
    return (days if r.grain == "day" else F.floor(days / 7)).cast("int")


def half_day(ts: Column) -> Column:
    """0 before noon, 1 until 17:00, 2 after."""
    h = F.hour(local(ts))
    return F.when(h < 12, 0).when(h < 17, 1).otherwise(2)


def validate_account_range(first: date, last: date) -> None:
    """Account pages take less than one year; from 29 February the year ends on 28 February."""
    try:
        limit = first.replace(year=first.year + 1)
    except ValueError:
        limit = date(first.year + 1, 2, 28)
    if last < first or last >= limit:
        raise ValueError("an account range is shorter than one year")


def resolve_anchor(latest: datetime, complete_hour: int = 23) -> date:
    """The last complete local day: that of the latest row if it reaches complete_hour, else the day before."""
    here = latest + OFFSET
    return here.date() if here.hour >= complete_hour else here.date() - timedelta(days=1)


def anchor_of(latest: Column, complete_hour: int = 23) -> Column:
    """resolve_anchor on a column of UTC-naive times."""
    here = local(latest)
    return F.when(F.hour(here) >= complete_hour, here.cast("date")).otherwise(F.date_sub(here.cast("date"), 1))


def coerced_time(raw: Column) -> Column:
    """Epoch seconds or ISO text as UTC-naive time: an offset or Z is applied, a text without one is taken as it is; anything else is null."""
    t = F.trim(raw)
    epoch = F.when(t.rlike(r"^[+-]?\d{1,11}$") & ~t.rlike(r"^[+-]?0$"), t.cast("long"))
    offset = F.regexp_extract(t, r"([+-]\d{2}:\d{2})$", 1)
    naive = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(t, r"(Z|[+-]\d{2}:\d{2})$", ""), "T", " ")).cast("timestamp_ntz")
    minutes = F.when(offset == "", 0).otherwise((F.substring(offset, 2, 2).cast("int") * 60 + F.substring(offset, 5, 2).cast("int")) * F.when(offset.startswith("-"), -1).otherwise(1))
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})?)?$"), naive - F.make_dt_interval(F.lit(0), F.lit(0), minutes))
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.coalesce(zero + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), epoch.cast("decimal(18,6)")), iso)
