from datetime import datetime

from pyspark.sql import functions as F

from chatterscope.operators import facts as T
from chatterscope.operators import sampling as S

NOW = datetime(2026, 1, 1)


def test_current_prefers_humans_then_newest(spark):
    log = spark.createDataFrame(
        [(1, "x", "pending", datetime(2026, 1, 3), None), (2, "x", "approved", datetime(2026, 1, 1), None), (3, "y", "pending", NOW, None), (4, "y", "pending", datetime(2026, 1, 2), 3), (5, "z", "rejected", NOW, None)],
        "annotation_id long, unit string, review_state string, created_at timestamp_ntz, supersedes_id long",
    )
    assert {r.unit: r.annotation_id for r in T.current(log, ["unit"]).collect()} == {"x": 2, "y": 4}


def test_merge_keeps_known_values(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id long, code string, v long")
    new = spark.createDataFrame([(1, "z", None), (3, "c", 7)], "id long, code string, v long")
    out = T.merge_snapshot(old, new, "id", ["code"], ["v"])
    assert {tuple(r) for r in out.collect()} == {(1, "a", 5), (2, "b", 6), (3, "c", 7)}
    assert {tuple(r) for r in T.merge_snapshot(out, new, "id", ["code"], ["v"]).collect()} == {tuple(r) for r in out.collect()}  # again: no change


def test_children_go_only_from_complete_snapshots(spark):
    old = spark.createDataFrame([(1, 10, 0), (2, 20, 0)], "c long, p long, v long")
    new = spark.createDataFrame([(3, 10, 1)], "c long, p long, v long")
    out = T.reconcile_children(old, new, spark.createDataFrame([(10,)], "p long"), "c", "p", "v")
    assert {r.c for r in out.collect()} == {2, 3}


def test_queue(spark):
    jobs = spark.createDataFrame([(1, "a", "pending", 5, None, 0), (2, "a", "running", 9, datetime(2025, 1, 1), 1), (3, "a", "running", 9, datetime(2027, 1, 1), 1), (4, "b", "pending", 1, None, 0)], "job_id long, subject_code string, status string, priority long, lease_until timestamp_ntz, attempts int")
    got = {r.job_id: (r.status, r.attempts) for r in T.claim(jobs, F.lit("2026-01-01 00:00:00").cast("timestamp_ntz"), 2).collect()}
    assert got == {1: ("running", 1), 2: ("running", 2), 3: ("running", 1), 4: ("pending", 0)}


def test_allocation():
    assert S.allocate({"a": 1, "b": 99}, 10) == {"a": 1, "b": 9}
    assert S.allocate({"a": 2, "b": 3}, 10) == {"a": 2, "b": 3}
    got = S.allocate({"a": 50, "b": 30, "c": 20}, 11)
    assert sum(got.values()) == 11 and got["a"] >= got["b"] >= got["c"] >= 1
