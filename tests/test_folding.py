"""Folding by sets and rounds against the sequential rule, over hashes that are near each other in every way."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from chatterscope.functions import text as X
from chatterscope.operators import folding


def sequential(rows, most=3):
    """(group, id) -> (rep, distance): in id order, to the nearest representative; ties by the first band they share, then by age."""
    reps, out = {}, {}
    for g, i, h in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        if h is None:
            out[g, i] = (i, None)
            continue
        u = h % 2**64
        near = []
        for n, (r, o) in enumerate(reps.get(g, [])):
            d = (u ^ o).bit_count()
            if d <= most:
                band = next(b for b in range(4) if (u ^ o) >> 16 * b & 0xFFFF == 0)
                near.append((d, band, n, r))
        if near:
            best = min(near)
            out[g, i] = (best[3], best[0])
        else:
            reps.setdefault(g, []).append((i, u))
            out[g, i] = (i, None)
    return out


def signed(h):
    return h - 2**64 if h >= 2**63 else h


def families(seed, n, groups):
    """Hashes around a few centres, up to eight flips away, with copies, chains of single flips, and some of their own."""
    rng = np.random.default_rng(seed)
    flip = lambda h, k: h ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False))
    centres = [int(x) * 2 + 1 for x in rng.integers(0, 2**63, 4)]
    chain = [centres[0]]
    for _ in range(40):
        chain.append(flip(chain[-1], 1))
    rows = []
    for i in rng.permutation(n):
        kind, g = rng.integers(0, 5), groups[int(rng.integers(0, len(groups)))]
        h = [lambda: flip(centres[int(rng.integers(0, 4))], int(rng.integers(0, 9))), lambda: chain[int(rng.integers(0, 41))], lambda: centres[1], lambda: int(rng.integers(0, 2**63)), lambda: None][kind]()
        rows.append((g, int(i), None if h is None else signed(h)))
    return rows


def test_rounds_equal_the_sequential_rule(spark):
    for seed, n, groups in ((0, 600, ["a"]), (1, 900, ["a", "b", None]), (2, 3, ["a"])):
        rows = families(seed, n, groups)
        df = spark.createDataFrame(rows, "g string, id long, hash long").repartition(5)
        got = folding.fold_hashes(df.select(F.struct("g").alias("grp"), "id", "hash")).collect()
        want = sequential(rows)
        assert len(got) == len(rows) and {(r.grp.g, r.id): (r.rep, r.distance) for r in got} == want
        if n > 10:
            assert {d for _, d in want.values()} == {None, 0, 1, 2, 3}
    none = spark.createDataFrame([], "grp struct<g:string>, id long, hash long")
    assert folding.fold_hashes(none).count() == 0


def test_copies_make_no_pairs(spark):
    """Two thirds of a group are copies of one text: links are between different hashes alone."""
    rows = [("g", i, 77 if i % 3 else 77 ^ 1 << (i % 5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, id long, hash long").select(F.struct("g").alias("grp"), "id", "hash")
    first = df.groupBy("grp", "hash").agg(F.min("id").alias("id"))
    assert folding.links(first).count() == 15  # six different hashes
    assert {(r.grp.g, r.id): (r.rep, r.distance) for r in folding.fold_hashes(df).collect()} == sequential(rows)


def test_hash_is_the_majority_of_pairs():
    def plain(text):
        pairs = [text[i : i + 2] for i in range(len(text) - 1)] or [text]
        hashes = [int.from_bytes(hashlib.blake2b(p.encode(errors="surrogatepass"), digest_size=8).digest(), "big") for p in pairs]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    hasher = folding.SimHasher()
    for text in ["ab", "a", "费率比同类低不少😀", "aaaa", "a\0b\0", "\0", "the quick brown fox " * 20, "\ud800x", *[f"text {i} of many" for i in range(50)]]:
        assert hasher.hash(text) == signed(plain(text))
    assert hasher.hash("") == 0


def test_no_whole_group_in_a_task(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("lang", "doc_id", "text")
    out = folding.folded(docs, ["lang"], "doc_id", "text")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "CartesianProduct" not in plan
    rows = [(r.lang, r.doc_id, signed(int(folding.SimHasher().hash(X.fold_text(r.text))) % 2**64) if len(X.fold_text(r.text)) > 1 else None) for r in docs.collect()]
    assert {(r.lang, r.doc_id): (r.rep, r.distance) for r in out.collect()} == sequential(rows)
