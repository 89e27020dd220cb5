"""Near-dedup's large groups, repeated ids and boilerplate against brute force."""

import numpy as np
import pytest

from chatterscope.llm import near_dup
from tests.llm.test_operators import brute_components

SCHEMA = "doc_id long, text string"


def got(df, **options):
    out = near_dup.near_duplicates(df, **options).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    return {r.doc_id: r.component_id for r in out}


def chains(n, most, seed=1):
    """Near copies of one base; with few changed words all are linked, with more only some."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        w = [f"b{j}" for j in range(120)]
        for j in rng.choice(120, rng.integers(0, most), replace=False):
            w[j] = f"x{i}_{j}"
        rows.append((i, " ".join(w)))
    return rows + [(10_000 + i, " ".join(f"u{i}_{j}" for j in range(50))) for i in range(20)]


@pytest.mark.parametrize("options", [{"unit": 20, "small": 40, "levels": 1}, {"unit": 20, "small": 30, "visits": 0}, {"unit": 1_000, "small": 40}])
def test_large_groups(spark, options):
    """Dense groups beyond every block: units in blocks, units confirmed in the trees' nodes, nodes that end at the last level."""
    rows = chains(260, 9)
    assert got(spark.createDataFrame(rows, SCHEMA), **options) == brute_components(rows)


def test_repeated_ids(spark):
    """All texts of an id are one document, also those without shingles and those under many ids."""
    one, two, near = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, one), (5, two), (3, one), (9, two + " x"), (9, ""), (2, None), (7, near), (7, near), (8, near + " y")] + [(100, f"{near} tail {i} of its own {i} kind") for i in range(30)] + [(50, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df) == brute_components(rows) == {5: 3, 3: 3, 9: 3, 2: 2, 7: 7, 8: 7, 100: 7, 50: 50}
    assert near_dup.near_duplicates(df).count() == len(rows)


def test_a_large_class_and_a_shared_passage(spark):
    """Twelve hundred copies with small changes, and documents that share a passage but are no copies: these branch until they are few."""
    rng = np.random.default_rng(4)
    base = [f"b{i}" for i in range(200)]
    passage = " ".join(f"p{i}" for i in range(60))
    rows = []
    for i in range(1_200):
        w = list(base)
        w[int(rng.integers(0, 200))] = f"x{i}"
        rows.append((i, " ".join(w)))
    own = [" ".join(f"o{i}_{j}" for j in range(60)) for i in range(600)]
    rows += [(10_000 + i, f"{own[i]} {passage}") for i in range(600)] + [(20_000 + i, f"{own[i]} {passage} z") for i in range(0, 600, 50)]
    want = {d: 0 if d < 1_200 else d if d < 20_000 else d - 10_000 for d, _ in rows}
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(4), small=50) == want


def test_trees_follow_from_recall():
    """The chance that two documents at the threshold never part, measured on random tokens."""
    rng = np.random.default_rng(7)
    levels, threshold, n = 3, 0.75, 4_000
    x = rng.integers(0, 1 << 32, (n, near_dup.POSITIONS), np.uint32)
    y = np.where(rng.random(x.shape) < threshold, x, rng.integers(0, 1 << 32, x.shape, np.uint32))
    node = near_dup.mixed(np.arange(n).astype(np.uint64))
    both = []
    for t in (x, y):
        at, row = node, np.arange(n)
        for _ in range(levels):
            at, row = near_dup.descend(at, row, t, threshold)
        both.append({(int(r), int(a)) for r, a in zip(row, at, strict=True)})
    missed = 1 - len({r for r, _ in both[0] & both[1]}) / n
    assert missed == pytest.approx(near_dup.lost(levels, threshold), abs=0.03)
    assert near_dup.lost(levels, threshold) ** near_dup.trees_for(0.999, levels, threshold) <= 0.001
