"""Views over raw rows without a copy of them, bound to one snapshot of their files.

A binding knows its files by number, bytes and a digest over path, length and time, which Spark takes from the listing
alone. Every action is checked before and after: one whose files changed meanwhile gives no result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterscope.sources import shared


class Changed(Exception):
    """The files are no longer those that were bound."""


@dataclass(frozen=True)
class Stamp:
    files: int
    bytes: int
    digest: int


def stamp(spark: SparkSession, path: str) -> Stamp:
    """What the listing says; no file is opened. Times count by the millisecond that the file system keeps."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "modificationTime", "length")
    one = F.xxhash64("path", F.unix_millis(F.col("modificationTime").cast("timestamp")), "length")
    r = files.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("b"), F.coalesce(F.bit_xor(one), F.lit(0)).alias("d")).first()
    return Stamp(r["n"], r["b"], r["d"])


class Bound:
    """Raw Parquet rows of a path, as they were when bound, and views over them.

    ``since`` leaves out rows before an instant of ``time``; the bound reaches the scan. Defined cases: a source column that
    is missing is null in every view that names it, under the type the view gives it; one of the ``required`` that is missing
    stops the binding; no rows give empty views.
    """

    def __init__(self, spark: SparkSession, path: str, required: tuple[str, ...] = (), time: str | None = None, since: datetime | None = None):
        self.spark, self.path, self.stamp, self.views = spark, path, stamp(spark, path), {}
        raw = spark.read.parquet(path)
        if lacking := [c for c in required if c not in raw.columns]:
            raise ValueError(f"blocked: the source lacks {lacking}")
        self.raw = raw if since is None else raw.where(F.col(time) >= F.lit(since))
        self.check()  # what was listed by the reader is what was bound

    def check(self) -> None:
        if (now := stamp(self.spark, self.path)) != self.stamp:
            raise Changed(f"{self.path}: {self.stamp} was bound, {now} is there; bind it anew")

    def view(self, name: str, columns: dict[str, tuple[str, str]], where: str | None = None) -> DataFrame:
        """A view by its columns: name -> (expression over the raw columns, type)."""
        rows = self.raw if where is None else self.raw.where(where)
        needed = {c: F.lit(None).cast(t) for c, (e, t) in columns.items() if e.isidentifier() and e not in rows.columns}
        out = rows.select(*[needed.get(c, F.expr(e).cast(t)).alias(c) for c, (e, t) in columns.items()])
        self.views[name] = out
        return out

    def sql(self, text: str) -> DataFrame:
        """SQL over the views by name, as {name}; it is planned against the bound files and runs inside ``action`` only."""
        return self.spark.sql(text, **self.views)

    def action(self, run: Callable[[], object]) -> object:
        """What ``run`` gives, if the files were the bound ones before and after it."""
        self.check()
        out = run()
        self.check()
        return out

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """df's rows as a table in the shared folder, proved to be of the snapshot."""
        return self.action(lambda: shared.written(df, name))
