"""A derived table filled afresh in key ranges, which goes on where it was interrupted and is activated only when whole.

The cursor is bound to a digest of the rule and its pool: under another rule or pool nothing is continued, a new pass begins.
Each range is one commit into a folder of its own, so a range that was cut off is written again and never doubles.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATE = "run string, at long, cursor long, digest string, status string"


class NotReady(ValueError):
    """A pass that may not go live."""


class Backfill:
    """``rule(rows, pool)`` gives the derived rows, with the key. ``version`` names the rule; the pool is part of the digest."""

    def __init__(self, spark: SparkSession, path: str, rule: Callable[[DataFrame, DataFrame], DataFrame], version: str, pool: DataFrame, key: str, resolved: str):
        self.spark, self.path, self.rule, self.pool, self.key, self.resolved = spark, path, rule, pool, key, resolved
        fields = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(pool.columns)]), {"ignoreNullFields": "false"})
        summed = pool.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(fields).cast("decimal(38,0)")).alias("s")).first()
        self.digest = hashlib.sha256(json.dumps([version, key, resolved, summed["n"], str(summed["s"])]).encode()).hexdigest()

    def state(self) -> DataFrame:
        try:
            return self.spark.read.schema(STATE).json(f"{self.path}/_state")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], STATE)

    def last(self) -> dict | None:
        found = self.state().orderBy(F.desc("at")).first()
        return found.asDict() if found else None

    def _tell(self, run: str, at: int, cursor: int | None, status: str) -> None:
        self.spark.createDataFrame([(run, at, cursor, self.digest, status)], STATE).coalesce(1).write.mode("append").json(f"{self.path}/_state")

    def run(self, rows: DataFrame, batches: int, *, resume: bool = False, progress: Callable[[int], None] = lambda cursor: None) -> None:
        """All rows by ascending key, in ``batches`` ranges of about as many rows. A new pass has a folder of its own.

        Keys have to be whole numbers; a null one is an error. Rows that came behind the cursor since wait for the next pass.
        """
        before = self.last()
        if resume and before and before["digest"] != self.digest:
            raise ValueError("the rule or its pool changed since the backfill began: start a new pass")
        if resume and before:
            run, at, cursor = before["run"], before["at"], before["cursor"]
        else:
            at = before["at"] + 1 if before else 0
            run, cursor = f"pass-{at}", None
            self._tell(run, at, None, "running")
        left = rows if cursor is None else rows.where(F.col(self.key).isNull() | (F.col(self.key) > cursor))
        cuts = left.agg(F.count_if(F.col(self.key).isNull()).alias("nulls"), F.max(self.key).alias("top"), F.percentile_approx(self.key, [i / batches for i in range(1, batches + 1)], 10_000).alias("cuts")).first()
        if cuts["nulls"]:
            raise ValueError(f"{cuts['nulls']} rows have no {self.key}")
        for through in sorted({*(cuts["cuts"] or []), *([] if cuts["top"] is None else [cuts["top"]])}):
            span = F.col(self.key) <= through
            if cursor is not None:
                span = span & (F.col(self.key) > cursor)
            self.rule(rows.where(span), self.pool).write.mode("overwrite").parquet(f"{self.path}/{run}/through={through}")
            cursor, at = through, at + 1
            self._tell(run, at, cursor, "running")
            progress(cursor)
        self._tell(run, at + 1, cursor, "populated")

    def filled(self) -> DataFrame:
        """The rows that the current pass has committed: a range past the cursor does not count."""
        s = self.last()
        if s is None or s["cursor"] is None:
            raise ValueError("nothing has been filled yet")
        return self.spark.read.parquet(f"{self.path}/{s['run']}").where(F.col("through") <= s["cursor"]).drop("through")

    def audit(self, by: str) -> DataFrame:
        return self.filled().groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count(self.resolved).alias("resolved"), F.count_if(F.col(self.resolved).isNull()).alias("unresolved"))

    def activate(self) -> None:
        """Only a whole pass under this very rule in which nothing is unresolved goes live."""
        s = self.last()
        if s is None or s["status"] not in ("populated", "active"):
            raise NotReady("the pass is not finished")
        if s["digest"] != self.digest:
            raise NotReady("the pass was made by another rule or pool")
        open_rows = self.filled().where(F.col(self.resolved).isNull()).count()
        if open_rows:
            raise NotReady(f"{open_rows} rows are unresolved")
        self._tell(s["run"], s["at"] + 1, s["cursor"], "active")

    def active(self) -> DataFrame:
        """The rows of the last pass that was activated, also while a newer one is filled."""
        s = self.state().where("status = 'active'").orderBy(F.desc("at")).first()
        if s is None:
            raise ValueError("no pass is active")
        return self.spark.read.parquet(f"{self.path}/{s['run']}").where(F.col("through") <= s["cursor"]).drop("through")
