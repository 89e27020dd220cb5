"""Merkle manifest, exact inner products and token alignment against brute force."""

import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from chatterscope.llm import alignment, inner_products, merkle, registry
from tests.llm.test_operators import docs, none, odd, odd_rows  # noqa: F401

H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()


def leaf(r, n_chars):
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return H(*map(said, (r.doc_id, r.source, r.lang, n_chars, r.text)))


def brute_tree(leaves, arity):
    """The root, and each leaf's siblings on its way up: (run without it, its place)."""
    level, at, paths = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        runs = [level[i : i + arity] for i in range(0, len(level), arity)]
        for k, i in enumerate(at):
            run = runs[i // arity]
            paths[k].append((run[: i % arity] + run[i % arity + 1 :], i % arity))
            at[k] = i // arity
        level = [H(*r) for r in runs]
    return level[0], paths


def brute_manifest(rows, arity=2):
    groups = {}
    for r in rows:
        groups.setdefault(r.lang, []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees, subroots = {}, []
    for g in order:
        groups[g].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.n_chars)))
        trees[g] = brute_tree([leaf(r, r.n_chars) for r in groups[g]], arity)
        subroots.append(trees[g][0])
    root, above = brute_tree(subroots, arity)
    out = Counter()
    for g, top in zip(order, above, strict=True):
        for r, path in zip(groups[g], trees[g][1], strict=True):
            hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0 and r.n_chars is not None
            h, proof = leaf(r, r.n_chars + hit if r.n_chars is not None else None), []
            for others, at in path + top:
                h = H(*others[:at], h, *others[at:])
                proof += others
            out[r.doc_id, leaf(r, r.n_chars), trees[g][0], root, H(*proof), h, h == root] += 1
    return out


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("arity, rows_a_part", [(2, 250_000), (2, 7), (3, 5), (5, 1)])
def test_manifest(docs, odd, none, arity, rows_a_part):  # noqa: F811
    hit = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 7 == 0
    tampered = {"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    extra = odd.unionByName(odd.where("doc_id < 3").withColumn("n_chars", F.lit(None).cast("long"))).withColumns({c: F.lit(1) for c in ("part", "tree", "leaf", "named", "start")})
    for frame in (docs, extra, odd.where("doc_id = 3"), odd.where("doc_id is null")):
        got = merkle.manifest(frame, tampered=tampered, arity=arity, rows_a_part=rows_a_part)
        assert got.columns == list(COLUMNS)
        assert Counter(tuple(r) for r in got.collect()) == brute_manifest(frame.collect(), arity)
    assert merkle.manifest(none, tampered=tampered, arity=arity).count() == 0


def test_manifest_of_many_groups_and_large_ids(spark):
    rows = [(2**60 + i if i % 9 else None, "s", f"g{i % 57:02d}" if i % 5 else None, i, f"t{i}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(7)
    want = {k[0:1] + k[1:5] for k in brute_manifest(df.collect())}
    got = merkle.manifest(df, rows_a_part=10)
    assert {tuple(r)[:5] for r in got.collect()} == want and all(r.verified for r in got.collect())


def test_forest_is_associative():
    leaves = [H(str(i)) for i in range(23)]
    want, _ = brute_tree(leaves, 3)

    def fragment(start, end):
        f = merkle.Forest(3, 1)
        f.put(0, 23, 0, start, leaves[start:end])
        f.settle()
        return f.open()

    def merge(*parts):
        f = merkle.Forest(3, 1)
        for nodes in parts:
            for tree, level, i, h in nodes:
                f.put(tree, 23, level, i, [h])
        f.settle()
        return f.open()

    a, b, c, d = fragment(0, 5), fragment(5, 6), fragment(6, 17), fragment(17, 23)
    assert merge(merge(a, b), merge(c, d)) == merge(a, merge(merge(b, c), d)) == merge(a, b, c, d) == [(merkle.TOP, 0, 0, want)]
    assert len(a) + len(b) + len(c) + len(d) < 23


def brute_products(rows, k=10):
    sound = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    usual = Counter(len(v) for _, v in sound).most_common(1)
    sound = [(i, v) for i, v in sound if len(v) == usual[0][0]] if usual else []
    out = {}
    for q, v in sound:
        if q % 100 == 0:
            for i, w in sound:
                if i != q:
                    s = sum(a * b for a, b in zip(v, w, strict=True))
                    out.setdefault(q, {})[i] = max(s, out.get(q, {}).get(i, s))
    return {(q, n + 1, i, s) for q, found in out.items() for n, (s, i) in enumerate(sorted((-s, i) for i, s in found.items())[:k]) for s in [-s]}


def test_inner_products(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    want = brute_products(rows)
    for bucket in (16_384, 40):
        got = inner_products.search(vectors.withColumns({c: F.lit(1) for c in ("id", "v", "norm", "asks", "bucket", "part", "floor")}), F.col("vec_id") % 100 == 0, bucket_rows=bucket)
        assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert inner_products.search(vectors.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_inner_products_of_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=5) * 10.0 ** rng.integers(-3, 4)]) for i in range(300)]
    rows += [(i, rows[i % 7][1]) for i in range(300, 380)]  # ties, and equal lengths
    rows += [(100, rows[3][1]), (100, rows[4][1]), (7, rows[9][1]), (7, rows[9][1])]  # repeated ids
    rows += [(400, None), (500, [1.0, None, 2.0, 3.0, 4.0]), (600, [1.0, float("nan"), 2.0, 3.0, 4.0]), (700, [float("inf")] * 5), (None, [1.0] * 5), (800, [1.0, 2.0]), (900, [0.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    for bucket in (16_384, 50):
        got = inner_products.search(df, F.col("vec_id") % 100 == 0, bucket_rows=bucket).collect()
        assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute_products(rows)
    few = inner_products.search(spark.createDataFrame([(0, [1.0, 2.0]), (1, [-1.0, 2.0]), (2, [3.0, -9.0])], "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0)
    assert [tuple(r) for r in few.orderBy("rank").collect()] == [(0, 1, 1, 3 * 1024**2), (0, 2, 2, -15 * 1024**2)]
    large = spark.createDataFrame([(0, [2.0**19, 1.0]), (1, [2.0**19, 3.0]), (2, [1e30, 0.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in inner_products.search(large, F.col("vec_id") % 100 == 0).collect()] == [(0, 1, 1, 2**58 + 3 * 2**20)]


def test_bounds_cut_pairs_and_lose_none():
    """Vectors whose lengths and first directions differ much: most pairs are never summed in full."""
    import pandas as pd

    rng = np.random.default_rng(1)
    x = (rng.normal(size=(3000, 32)) * 0.85 ** np.arange(32) * rng.exponential(size=(3000, 1)) * 1000).astype(np.int64)
    held = pd.DataFrame({"id": np.arange(3000), "v": list(x), "norm": np.sqrt((x * x).sum(1).astype(float))})
    asks = held.iloc[:40].assign(floor=-np.inf)
    basis = np.linalg.eigh(x.T.astype(float) @ x.astype(float))[1][:, ::-1]
    counter = [0, 0]
    found = inner_products.search_bucket(held, asks, basis, 10, counter)
    scores = x[:40] @ x.T
    np.fill_diagonal(scores[:, :40], -(2**60))
    for q in range(40):
        want = np.lexsort((np.arange(3000), -scores[q]))[:10]
        assert found[found["query_id"] == q][["vec_id", "score"]].values.tolist() == [[int(i), int(scores[q, i])] for i in want]
    asks = asks.assign(floor=np.sort(scores, axis=1)[:, -10].astype(float))
    counter = [0, 0]
    inner_products.search_bucket(held, asks, basis, 10, counter)
    assert counter[0] == 40 * 3000 and counter[1] < 0.05 * counter[0]


def brute_alignment(texts):
    """Each text's groups by walking over byte offsets, with the tokenizers' own libraries."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}
    out = []
    for text in texts:
        groups = []
        if text:
            a = one.encode(" " + text, add_special_tokens=False)
            a = [(i, bytes(back[c] for c in t)) for i, t in zip(a.ids, a.tokens, strict=True)]
            b = [(i, bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode()) for i in two.encode(text) for p in [two.id_to_piece(i)]]
            if b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode():
                i = j = 0
                x, y, ea, eb = [], [], 0, 0
                while i < len(a) or j < len(b):
                    if ea <= eb:
                        x.append(a[i][0])
                        ea += len(a[i][1])
                        i += 1
                    else:
                        y.append(b[j][0])
                        eb += len(b[j][1])
                        j += 1
                    if ea == eb:
                        groups.append((x, y))
                        x, y = [], []
        out.append(groups)
    links = Counter((x[-1], y[-1]) for groups in out for x, y in groups)
    most = {}
    for (_, b), n in links.items():
        most[b] = max(most.get(b, 0), n)
    rows = []
    for groups in out:
        ends = [(x[-1], y[-1]) for x, y in groups]
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        rows.append((sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(ends), sum(links[e] == most[e[1]] for e in ends), sum(links[e] for e in ends), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return rows


@pytest.mark.parametrize("wide", [alignment.WIDE, 3, 0])
def test_alignment(spark, docs, odd, none, wide):  # noqa: F811
    texts = ["a <|endoftext|> b<s></s><unk><0x41>▁", "  two  spaces \n\n\t", "漢字 😀 é ﬁ ①", "　", "ſ́é naïve", "a" * 3000, " ", "x\x00y\x7f", "don't  stop 12345 67.89 ***", None, ""]
    frames = [spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), odd.withColumns({c: F.lit(1) for c in ("row", "pairs", "n_a")}), docs]
    for frame in frames:
        rows = frame.collect()
        want = Counter((r.doc_id, *x) for r, x in zip(rows, brute_alignment([r.text for r in rows]), strict=True))
        got = alignment.digest(alignment.align(frame), wide=wide)
        assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        assert Counter(tuple(r) for r in got.collect()) == want
    assert alignment.digest(alignment.align(none), wide=wide).count() == 0


def test_intervals_by_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        cuts = lambda: np.diff([0, *sorted(rng.choice(np.arange(1, n), int(rng.integers(0, n)), replace=False)), n])
        a, b = cuts(), cuts()
        one, two = np.cumsum(a), np.cumsum(b)
        x, y = alignment.boundaries(a, b)
        assert [(one[i], two[j]) for i, j in zip(x, y, strict=True)] == [(e, e) for e in sorted(set(one) & set(two))]
        first, after = alignment.Intervals(b).stab(one - a, one)
        for s, e, f, g in zip(one - a, one, first, after, strict=True):
            assert list(range(f, g)) == [j for j in range(len(b)) if two[j] > s and two[j] - b[j] < e]


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = registry.QUERIES[name](spark, sf)
    r = con.execute(registry.ORACLES[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted((tuple(dict(zip(names, x, strict=True))[c] for c in df.columns) for x in r.fetchall()), key=repr) == sorted(map(tuple, df.collect()), key=repr)
