"""Posting lists: what routing holds where there are many centroids, and comparing by products against plain differences."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chatterscope.llm import posting_lists


def rows(n, seed=1, size=32):
    return np.random.default_rng(seed).normal(size=(n, size)).astype(np.float32)


def test_routing_holds_little_and_gives_small_frames(spark, monkeypatch):
    """Two thousand lists, of which each query reads most: the frames of a task that routes, and its peak."""
    made, frame = [], type(spark.range(1))
    real = frame.mapInPandas
    monkeypatch.setattr(frame, "mapInPandas", lambda self, f, schema: made.append(f) or real(self, f, schema))
    monkeypatch.setattr(posting_lists, "balanced_kmeans", lambda x, k: rows(2_000, 2))
    monkeypatch.setattr(posting_lists, "needed_ratio", lambda *a: 1.5)
    x = rows(40)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    posting_lists.search(df, F.col("vec_id") % 10 == 0, k=2)
    asked = pd.DataFrame({"id": np.arange(1_000), "v": list(rows(1_000, 3))})
    tracemalloc.start()
    sizes = [len(f) for f in made[1](iter([asked]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sizes) > 500_000 and max(sizes) <= 10_000 and peak < 100e6


@pytest.mark.parametrize("scale", [1.0, 1e-6, 1e9])
def test_nearest_against_plain_differences(scale):
    """Repeated ids, equal vectors, ties, queries among the rows; far from the origin, where products round most."""
    rng = np.random.default_rng(5)
    x = (rng.integers(0, 3, (300, 6)) + 1e5) * scale
    own, q = rng.integers(0, 200, 300), np.arange(40)
    v = np.concatenate([x[:30], (rng.normal(size=(10, 6)) + 1e5) * scale])
    for k in (1, 7, 500):
        got = list(zip(*(a.tolist() for a in posting_lists.nearest(x, own, v, q, k)), strict=True))
        want = []
        for a, b in zip(q, v, strict=True):
            d = np.sqrt(((x - b) ** 2).sum(1))
            best = sorted((d[own == i].min(), i) for i in set(own.tolist()) if i != a)[:k]
            want += [(int(a), i, float(f)) for f, i in best]
        assert got == want


def test_squares_beyond_all_numbers():
    x = np.array([[1e200, 1.0], [1e200, 3.0], [0.0, 1.0]])
    got = posting_lists.nearest(x, np.array([1, 2, 3]), x[:1], np.array([1]), 2)
    assert [a.tolist() for a in got] == [[1], [2], [2.0]]
