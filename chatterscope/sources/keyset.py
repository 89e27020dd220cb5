"""Keyset pages and a stream over them: offsets are (time, id) pairs, so rows of one instant are never lost or doubled."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def required(df: DataFrame, columns: dict[str, str]) -> None:
    """Fail closed if the source lacks a column or has it under another type."""
    have = dict(df.dtypes)
    bad = {c: have.get(c) for c, t in columns.items() if have.get(c) != t}
    if bad:
        raise ValueError(f"blocked: source columns differ: {bad}")


def watermark(rows: DataFrame, ts: str, key: str) -> Row | None:
    """The highest (ts, key)."""
    return rows.agg(F.max(F.struct(ts, key)).alias("m")).first()["m"]


def page(rows: DataFrame, ts: str, key: str, after: tuple[datetime, int] | None, through: tuple[datetime, int], limit: int) -> DataFrame:
    """The next rows in (ts, key) order, after one cursor and up to another. The plain bound on ts reaches the scan."""
    out = rows.where((F.col(ts) < F.lit(through[0])) | ((F.col(ts) == F.lit(through[0])) & (F.col(key) <= through[1])))
    if after is not None:
        out = out.where(F.col(ts) >= F.lit(after[0])).where((F.col(ts) > F.lit(after[0])) | (F.col(key) > after[1]))
    return out.orderBy(ts, key).limit(limit)


def targeted(rows: DataFrame, ids: DataFrame, key: str, times: list[str]) -> DataFrame:
    """Rows of the given ids; observed_at is the latest time that is known."""
    return rows.join(ids.select(key).distinct(), key, "left_semi").withColumn("observed_at", F.greatest(*times))
