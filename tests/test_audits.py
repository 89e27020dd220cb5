"""The audit report on small rows, and views whose files change."""

import time
from datetime import datetime

import pytest

from chatterscope.operators import audit as A
from chatterscope.sources import views as V

JOBS = "unit long, code string, task string, status string, last_error string"
RUNS = "run_id string, task string, provider string, started_at timestamp, input_count long, success_count long, error_count long, token_input long, token_output long, token_reasoning long"
LOG = "annotation_id long, unit long, code string, kind string, value string, tags array<string>, review_state string, created_at timestamp, supersedes_id long, provider string, run_id string"
AT = datetime(2024, 1, 1)


def told(df):
    return {(r["section"], r["name"], r["measure"]): r["value"] for r in df.collect()}


def frames(spark, jobs=(), runs=(), log=(), evidence=()):
    return spark.createDataFrame(list(jobs), JOBS), spark.createDataFrame(list(runs), RUNS), spark.createDataFrame(list(log), LOG), spark.createDataFrame([(e,) for e in evidence], "annotation_id long")


def row(i, unit, kind, value, tags=None, state="approved", before=None, run="r1", code="a"):
    return (i, unit, code, kind, value, tags, state, AT, before, "llm", run)


def test_report_of_nothing(spark):
    got = told(A.report(*frames(spark), ["unit", "code"], "code"))
    assert got == {
        ("annotations", "all", "rows"): 0, ("annotations", "all", "rule_rows"): 0, ("annotations", "all", "needs_review_rate"): 0, ("annotations", "all", "evidence_located_rate"): None, ("compliance", "all", "scanned_units"): 0,
    }


def test_report(spark):
    jobs = [(1, "a", "t", "done", None), (2, "a", "t", "dead", "x" * 200), (3, "a", "t", "dead", None), (4, "b", "t", "pending", None)]
    runs = [("r1", "t", "llm", AT, 5, 4, 1, None, 9, 9), ("r2", "t", "llm", AT, 1, 1, None, 10, 2, None), ("r3", "u", "rule", None, 3, 3, 0, None, None, None)]
    log = [
        row(1, 1, "relevance", "irrelevant"), row(2, 1, "relevance", "relevant", before=1), row(3, 1, "attitude", "positive"), row(4, 2, "relevance", "needs_context", state="needs_review"),
        row(5, 2, "attitude", "negative"), row(6, 3, "attitude", "neutral", run="r2"), row(7, 1, "compliance", None, ["p", "q"]), row(8, 2, "compliance", None, []), row(9, 1, "text_quality", None),
    ]
    parts = frames(spark, jobs, runs, log, [2, 2])
    got = told(A.report(*parts, ["unit", "code"], "code"))
    assert got["queue", "t", "completion"] == 0.25 and got["queue", "t", "dead"] == 2
    assert got["dead letters", "x" * 120, "jobs"] == 1 and got["dead letters", "", "jobs"] == 1
    assert got["usage", "t", "runs"] == 2 and got["usage", "t", "unknown_usage_runs"] == 1 and got["usage", "t", "token_output"] == 2 and got["usage", "t", "token_reasoning"] == 0
    assert got["usage", "u", "unknown_usage_runs"] == 0
    # unit 1 was irrelevant before; unit 2 lacks context; unit 3 has no relevance
    assert got["attitudes", "a", "positive"] == 1 and ("attitudes", "a", "negative") not in got and ("attitudes", "a", "neutral") not in got
    assert got["attitudes", "a", "irrelevant"] == 0 and got["attitudes", "a", "needs_context"] == 1
    assert got["compliance", "all", "scanned_units"] == 2 and got["compliance", "tags", "q"] == 1
    assert got["annotations", "all", "evidence_located_rate"] == 1 and got["annotations", "all", "needs_review_rate"] == round(1 / 9, 4)
    assert got["prefilter", "rule", "unknown"] == 1
    scope = spark.createDataFrame([(3, "a"), (3, "a")], "unit long, code string")
    got = told(A.report(*parts, ["unit", "code"], "code", scope))
    assert got["annotations", "all", "rows"] == 1 and got["usage", "t", "runs"] == 1 and got["queue", "t", "completion"] == 0 and got["annotations", "all", "evidence_located_rate"] is None


def test_views_stop_when_files_change(spark, tmp_path):
    at = str(tmp_path / "raw")
    write = lambda ids, mode: spark.createDataFrame([(i, datetime(2024, 1, i)) for i in ids], "id long, at timestamp").coalesce(1).write.mode(mode).parquet(at)
    write([1, 2, 3], "overwrite")
    bound = V.Bound(spark, at, required=("id",), time="at", since=datetime(2024, 1, 2))
    posts = bound.view("posts", {"n": ("id * 10", "long"), "title": ("title", "string")}, "id < 9")
    assert posts.dtypes == [("n", "bigint"), ("title", "string")]
    assert sorted(bound.action(bound.sql("select * from {posts}").collect)) == [(20, None), (30, None)]
    with pytest.raises(ValueError, match="lacks"):
        V.Bound(spark, at, required=("uid",))
    with pytest.raises(V.Changed):  # while the action runs: its result is not given
        bound.action(lambda: (posts.count(), write([4], "append")))
    with pytest.raises(V.Changed):  # and before any later one
        bound.action(posts.count)
    fresh = V.Bound(spark, at)
    assert fresh.stamp.files > bound.stamp.files and fresh.action(fresh.raw.count) == 4
    time.sleep(0.01)
    write([1, 2, 3, 4], "overwrite")
    with pytest.raises(V.Changed):
        fresh.check()
