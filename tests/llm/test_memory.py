"""What a task holds at its peak, by tracemalloc (numpy's arrays count)."""

import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa

from chatterscope.llm import near_dup, suffix_tree

TOKENS, TEXT = 200_000, 500


class Store:
    """Takes the functions that would run in tasks."""

    def mapInPandas(self, f, schema):  # noqa: N802
        self.each = f
        return self

    def groupBy(self, *by):  # noqa: N802
        return self

    def applyInPandas(self, f, schema):  # noqa: N802
        self.merged = f
        return self


def stored(rng, words):
    lengths = np.full(TOKENS // TEXT, TEXT, np.int64)
    ids = rng.integers(1, words, TOKENS).astype(np.int32)
    hashes = np.random.default_rng(1).integers(-(2**62), 2**62, words)
    return pd.DataFrame({
        "chunk": [0], "doc_id": [[str(i) for i in range(len(lengths))]], "train": [np.ones(len(lengths), bool).tobytes()],
        "lengths": [lengths.tobytes()], "words": [hashes.tobytes()], "ids": [pa.compress(ids.tobytes(), "zstd", asbytes=True)],
    })


def peak(rows):
    tracemalloc.start()
    try:
        for _ in rows:
            pass
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def every(c):
    return np.ones(len(c.at), bool)


def test_counting_and_asking_hold_little(monkeypatch):
    monkeypatch.setattr(suffix_tree, "NUMBERS", 1_000_000)
    rng = np.random.default_rng(3)
    data = [stored(rng, 60_000) for _ in range(6)]
    for depth in (1, 3):
        store = Store()
        suffix_tree.counted(store, depth, every, 10, 6)
        assert peak(store.each(iter(data))) < 90 * 1_200_000  # before: 111 bytes a number
    head, maps = SimpleNamespace(value=[np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]), SimpleNamespace(value=(np.full(1 << 20, 255, np.uint8),) * 2)
    assert peak(suffix_tree._ask(head, maps, 4, 6)(iter(data))) < 250 * TOKENS


def test_counts_of_grams(monkeypatch):
    monkeypatch.setattr(suffix_tree, "NUMBERS", 300_000)
    rng = np.random.default_rng(4)
    data = [stored(rng, 40) for _ in range(3)]
    store, want = Store(), Counter()
    suffix_tree.counted(store, 2, every, 30, 3)
    packed = pd.concat(list(store.each(iter(data))))
    got = pd.concat([store.merged(g) for _, g in packed.groupby("bucket")])
    for row in data:
        c = suffix_tree.Chunk(row.iloc[0], 2)
        for i in np.flatnonzero(c.at >= 2):
            want[c.grams[1][i - 1], c.grams[1][i]] += 1
    assert len(packed) > len(set(packed["bucket"]))  # several packs of a bucket were merged
    assert {(a, b): n for a, b, n in zip(got["ctx"], got["suf"], got["n"], strict=True)} == {k: n for k, n in want.items() if n >= 30}
    assert (suffix_tree.mixed(got["ctx"].to_numpy(), got["suf"].to_numpy(), 2) == got["key"].to_numpy()).all()


def test_sketching_holds_one_set(spark):
    class Docs(Store):
        def select(self, *columns):
            return self

    store = Docs()
    near_dup.sketches(store, 5)
    rng = np.random.default_rng(5)
    texts = [" ".join(map(str, rng.integers(0, 50_000, 2_000))) for _ in range(500)]
    pdf = pd.DataFrame({"doc_id": range(len(texts) + 2), "text": [*texts, None, " "]})
    list(store.each(iter([pdf])))
    assert peak(store.each(iter([pdf]))) < 13_000_000  # before, all sets at once: 16.7 MB
    out = next(store.each(iter([pdf])))
    assert [(r.n_shingles, pd.isna(r.key), r.tokens, r.sig) for r in out.tail(2).itertuples()] == [(0, True, None, None)] * 2
    assert all((np.frombuffer(r.sig, np.uint8) == np.frombuffer(r.tokens, "<u4") % 256).all() for r in out.head(500).itertuples())
    assert next(store.each(iter([pdf.head(0)]))).empty
