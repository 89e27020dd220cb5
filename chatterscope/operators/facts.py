"""Versioned annotations, routing, merging, catalog and queue transitions as DataFrame -> DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

HUMAN = ("approved", "corrected")


def chain_ends(log: DataFrame) -> DataFrame:
    """Rows that no other row supersedes."""
    newer = log.where("supersedes_id is not null").select(F.col("supersedes_id").alias("annotation_id")).distinct()
    return log.join(newer, "annotation_id", "left_anti")


def current(log: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the row that counts: chain end, not rejected; human-settled first, then newest, then highest id."""
    rows = chain_ends(log).where("review_state <> 'rejected'")
    order = F.struct(F.col("review_state").isin(*HUMAN).cast("int"), F.col("created_at"), F.col("annotation_id"))
    rest = [c for c in log.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return best.select(*keys, "_r.*")


def latest_per(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def released(log: DataFrame, keys: list[str], jobs: DataFrame, prompts: list[str]) -> DataFrame:
    """Current rows from an allowed run whose latest job is done or absent. jobs: keys, job_id, status."""
    last = jobs.groupBy(*keys).agg(F.max_by("status", "job_id").alias("_status"))
    rows = current(log, keys).where((F.col("provider") != "rule") & F.col("prompt_version").isin(*prompts))
    return rows.join(last, keys, "left").where("_status is null or _status = 'done'").drop("_status")


def routes(parent: DataFrame, own: DataFrame) -> DataFrame:
    """comment_id, code, matched_parent, matched_comment over both sides' (comment_id, code)."""
    a = parent.distinct().withColumn("matched_parent", F.lit(True))
    b = own.distinct().withColumn("matched_comment", F.lit(True))
    return a.join(b, ["comment_id", "code"], "full_outer").na.fill(False, ["matched_parent", "matched_comment"])


def set_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key and change: added, removed or retained."""
    both = old.select(key).distinct().withColumn("_o", F.lit(1)).join(new.select(key).distinct().withColumn("_n", F.lit(1)), key, "full_outer")
    return both.select(key, F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").otherwise("retained").alias("change"))


def compared(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows by kind of difference; fields compare null-safely."""
    a = left.select(key, F.struct(*fields).alias("_a"), F.lit(1).alias("_l"))
    b = right.select(key, F.struct(*fields).alias("_b"), F.lit(1).alias("_r"))
    kind = F.when(F.col("_r").isNull(), "extra").when(F.col("_l").isNull(), "missing").when(F.col("_a").eqNullSafe(F.col("_b")), "equal").otherwise("different")
    return a.join(b, key, "full_outer").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def merge_snapshot(old: DataFrame, new: DataFrame, key: str, immutable: list[str], fields: list[str]) -> DataFrame:
    """Upsert in which null never erases a known value and immutable fields keep the first."""
    a = old.select(key, *[F.col(c).alias(f"_o_{c}") for c in immutable + fields])
    b = new.select(key, *[F.col(c).alias(f"_n_{c}") for c in immutable + fields])
    picked = [F.coalesce(f"_o_{c}", f"_n_{c}").alias(c) for c in immutable] + [F.coalesce(f"_n_{c}", f"_o_{c}").alias(c) for c in fields]
    return a.join(b, key, "full_outer").select(key, *picked)


def reconcile_children(old: DataFrame, new: DataFrame, complete: DataFrame, key: str, parent: str, value: str) -> DataFrame:
    """Children after a snapshot: upserts; a child that is absent goes only where the parent's snapshot is complete."""
    a = old.select(key, F.col(parent).alias("_po"), F.col(value).alias("_vo"))
    b = new.select(key, F.col(parent).alias("_pn"), F.col(value).alias("_vn"))
    both = a.join(b, key, "full_outer").select(key, F.coalesce("_pn", "_po").alias(parent), F.coalesce("_vn", "_vo").alias(value), F.col("_pn").isNotNull().alias("_seen"))
    done = complete.select(parent).distinct().withColumn("_done", F.lit(True))
    return both.join(done, parent, "left").where(F.col("_seen") | F.col("_done").isNull()).select(key, parent, value)


def settled_counters(observations: DataFrame, posts: DataFrame, hours: int = 24) -> DataFrame:
    """Per post the first observation at least ``hours`` after it; without one, the latest so far, not settled."""
    at = observations.join(posts.select("feed_id", "posted_at"), "feed_id")
    ripe = F.col("observed_at") >= F.col("posted_at") + F.expr(f"INTERVAL {hours} HOURS")
    found = at.groupBy("feed_id").agg(F.min_by("likes", F.when(ripe, F.col("observed_at"))).alias("_s"), F.bool_or(ripe).alias("settled"), F.max_by("likes", "observed_at").alias("_l"))
    return found.select("feed_id", "settled", F.when(F.col("settled"), F.col("_s")).otherwise(F.col("_l")).alias("likes"))


def claim(jobs: DataFrame, now: Column, limit: int, lease_minutes: int = 10) -> DataFrame:
    """The next state of the queue: the ``limit`` first open or expired jobs become running under a new lease."""
    open_ = (F.col("status") == "pending") | ((F.col("status") == "running") & (F.col("lease_until") < now))
    first = jobs.where(open_).orderBy(F.desc("priority"), "subject_code", "job_id").limit(limit).select("job_id", F.lit(True).alias("_first"))
    out = jobs.join(F.broadcast(first), "job_id", "left").withColumn("_go", F.coalesce("_first", F.lit(False))).drop("_first")  # ``limit`` rows
    lease = now + F.expr(f"INTERVAL {lease_minutes} MINUTES")
    return out.withColumns({"status": F.when(F.col("_go"), "running").otherwise(F.col("status")), "lease_until": F.when(F.col("_go"), lease).otherwise(F.col("lease_until")), "attempts": F.col("attempts") + F.col("_go").cast("int")}).drop("_go")


def retry_or_dead(jobs: DataFrame, failed: DataFrame, most: int = 3) -> DataFrame:
    out = jobs.join(failed.select("job_id").distinct().withColumn("_f", F.lit(True)), "job_id", "left")
    return out.withColumn("status", F.when(F.col("_f") & (F.col("attempts") >= most), "dead").when(F.col("_f"), "pending").otherwise(F.col("status"))).drop("_f")


def superseded(jobs: DataFrame, valid: DataFrame, keys: list[str]) -> DataFrame:
    """Open jobs whose key is no longer valid become superseded."""
    out = jobs.join(valid.select(*keys).distinct().withColumn("_v", F.lit(True)), keys, "left")
    return out.withColumn("status", F.when(F.col("_v").isNull() & F.col("status").isin("pending", "running"), "superseded").otherwise(F.col("status"))).drop("_v")


def first_wins(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    both = first.withColumn("_p", F.lit(0)).unionByName(second.withColumn("_p", F.lit(1)))
    rest = [c for c in first.columns if c not in keys]
    return both.groupBy(*keys).agg(F.min_by(F.struct(*rest), "_p").alias("_r")).select(*keys, "_r.*")


def stages(units: DataFrame, keys: list[str], days: int, half_day: bool) -> DataFrame:
    """Units (keys, i, cat) get their stage number.

    Units without category go to the stage before them, or lead into the first; equal neighbours merge. In views of 14
    days or more a stage of at most one valid unit merges into the one before it.
    """
    w = W.partitionBy(*keys).orderBy("i")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    filled = units.withColumn("_c", F.last("cat", ignorenulls=True).over(upto))
    filled = filled.withColumn("_c", F.coalesce("_c", F.first("cat", ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))))
    new = (~F.col("_c").eqNullSafe(F.lag("_c").over(w))) | (F.row_number().over(w) == 1)
    out = filled.withColumn("stage", F.sum(new.cast("int")).over(upto))
    if half_day or days < 14:
        return out.withColumnRenamed("_c", "stage_cat")
    valid = F.sum(F.col("cat").isNotNull().cast("int")).over(W.partitionBy(*keys, "stage"))
    out = out.withColumn("_v", valid)
    head = (F.lag("stage").over(w).isNull()) | ((F.col("stage") != F.lag("stage").over(w)) & (F.col("_v") > 1))
    out = out.withColumn("stage", F.sum(head.cast("int")).over(upto))
    first = F.first("_c").over(W.partitionBy(*keys, "stage").orderBy("i"))
    return out.withColumn("stage_cat", first).drop("_c", "_v")
