"""Origins of corrected annotations against a walk hop by hop."""

import json
import random

from chatterscope.operators import reviews
from chatterscope.operators.facts import HUMAN

LOG = "annotation_id long, target_type string, target_id long, subject_code string, kind string, value_json string, review_state string, run_id string, input_hash string, supersedes_id long"
DECISIONS = "decision_id long, annotation_id long, decision string, corrected_value_json string"


def parsed(text):
    try:
        return True, json.loads(text)
    except (TypeError, ValueError):
        return False, None


def walk(row, by_id, decisions):
    """(origin, run, hops), or three Nones."""
    seen, hops = set(), 0
    while row[7] is not None and row[7].startswith("review:"):
        suffix = row[7].removeprefix("review:")
        if row[6] not in HUMAN or not suffix.isascii() or not suffix.isdigit() or suffix.startswith("0") or suffix in seen:
            return None, None, None
        seen.add(suffix)
        d = decisions.get(int(suffix))
        if d is None or d[2] != "correct" or row[9] is None or row[9] != d[1] or parsed(d[3]) != parsed(row[5]) or not parsed(d[3])[0]:
            return None, None, None
        before = by_id.get(d[1])
        if before is None or before[1:5] != row[1:5] or before[8] != row[8] or not parsed(before[5])[0]:
            return None, None, None
        row, hops = before, hops + 1
    return row[0], row[7], hops


def check(spark, log, decisions):
    by_id, made = {r[0]: r for r in log}, {d[0]: d for d in decisions}
    got = reviews.origins(spark.createDataFrame(log, LOG).repartition(3), spark.createDataFrame(decisions, DECISIONS)).collect()
    assert len(got) == len(log)
    assert {r.annotation_id: (r.origin_id, r.origin_run, r.hops) for r in got} == {r[0]: walk(r, by_id, made) for r in log}
    return {r.annotation_id: r.hops for r in got}


def chain(first, n, run="run"):
    """A run's row and n corrections of it, one after the other."""
    log = [(first, "comment", 1, "p", "k", '{"v": 0}', "pending", run, "h", None)]
    log += [(first + i, "comment", 1, "p", "k", f'{{"v": {i}, "w": [1]}}', "corrected", f"review:{1000 + first + i}", "h", first + i - 1) for i in range(1, n + 1)]
    return log, [(1000 + first + i, first + i - 1, "correct", f'{{"w":[1],"v":{i}}}') for i in range(1, n + 1)]


def test_chains_of_any_length(spark):
    log, decisions = [], []
    for n in (0, 1, 2, 3, 7, 8, 20, 33):
        a, b = chain(100 * n + 1, n, f"run-{n}")
        log, decisions = log + a, decisions + b
    found = check(spark, log, decisions)
    assert sorted(set(found.values())) == list(range(34))


def test_every_hop_is_proved(spark):
    for at, value in ((5, '{"v": 9}'), (5, "no json"), (5, None), (6, "pending"), (7, "review:0"), (7, "review:+5"), (7, "review:"), (7, "review:01004"), (7, None), (1, "feed"), (2, 2), (2, None), (3, "q"), (4, "other"), (8, "x"), (8, None), (9, 77), (9, None)):
        log, decisions = chain(1, 5)
        row = list(log[3])
        row[at] = value
        check(spark, [*log[:3], tuple(row), *log[4:]], decisions)
    for at, value in ((1, 1), (2, "approve"), (2, None), (3, None), (3, "{"), (3, '{"v": 1}'), (0, 5)):
        log, decisions = chain(1, 5)
        row = list(decisions[2])
        row[at] = value
        check(spark, log, [*decisions[:2], tuple(row), *decisions[3:]])


def test_circles_have_no_origin(spark):
    log, decisions = chain(1, 6)
    log[0] = (*log[0][:5], '{"v": 0, "w": [1]}', "approved", "review:5000", "h", 7)
    found = check(spark, log, [*decisions, (5000, 7, "correct", '{"v": 0, "w": [1]}')])
    assert set(found.values()) == {None}
    alone = (1, "comment", 1, "p", "k", "1", "approved", "review:9", "h", 1)
    tail, more = chain(50, 3)
    assert check(spark, [alone, *tail], [(9, 1, "correct", "1"), *more]) == {1: None, 50: 0, 51: 1, 52: 2, 53: 3}


def test_random_logs(spark):
    rng = random.Random(4)
    pick = lambda *x: rng.choice(x)
    for _ in range(3):
        log = [(i, "comment", 1, pick("p", "p", "p", "p", "q"), "k", pick("1", "1", "1", "2"), pick("approved", "corrected", "corrected", "pending"), pick("run", *["review:" + str(i)] * 6), "h", rng.randrange(1, 80)) for i in range(1, 80)]
        decisions = [(r[0], r[9] if rng.random() < 0.95 else 3, pick(*["correct"] * 9, "reject"), r[5]) for r in log]
        check(spark, log, decisions)


def test_empty(spark):
    assert reviews.origins(spark.createDataFrame([], LOG), spark.createDataFrame([], DECISIONS)).count() == 0
