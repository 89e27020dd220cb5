"""Operators' inner figures against plain Python: distances, probabilities, spans, cuts; and the pipeline's stages on odd tables."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from chatterscope.llm import ordinal_quality, quality_rules, secret_scan, sharding
from tests.llm.test_operators import WORD, docs, none, odd, rules  # noqa: F401  fixtures

def histograms(text, common):
    """Shares of character classes and of common words, the rest last."""
    import unicodedata

    kind = lambda c: unicodedata.category(c)
    tests = [lambda c: kind(c) == "Ll", lambda c: kind(c) == "Lu", lambda c: kind(c) == "Nd", lambda c: c in " \t\n\x0b\x0c\r", lambda c: c in ".,;:!?'()\"-", lambda c: c in "#*$%&|<>"]
    counts = [sum(map(t, text)) for t in tests]
    words = WORD.findall(text)
    hits = [sum(w == x for w in words) for x in common]
    return [x / len(text) for x in [*counts, len(text) - sum(counts)]], [x / len(words) for x in [*hits, len(words) - sum(hits)]]


def js(p, q):
    half = lambda a, b: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b, strict=True) if x > 0)
    return math.sqrt(max(0.0, 0.5 * half(p, q) + 0.5 * half(q, p)))


def test_divergence_by_brute_force(docs):  # noqa: F811
    """Distances to the medians of each language, and the verdict on both together."""
    rows = {r.doc_id: r for r in docs.collect()}
    facts = {d: rules(r.text or "") for d, r in rows.items()}
    lists = quality_rules.COMMON_WORDS
    every = sorted({x for v in lists.values() for x in v})
    shares, reference = {}, {}
    for lang in {r.lang for r in rows.values()}:
        own = {d: histograms(r.text, lists.get(lang, every)) for d, r in rows.items() if r.lang == lang and facts[d][0] >= 50}
        shares |= own
        middle = lambda k: [sorted(x)[math.ceil(len(x) / 2) - 1] for x in zip(*(h[k] for h in own.values()), strict=True)]  # noqa: E731, B023
        reference[lang] = [[x / sum(m) for x in m] for m in (middle(0), middle(1))] if own else None
    seen = 0
    for r in quality_rules.quality_rules(docs).collect():
        if facts[r.doc_id][0] < 50:
            assert r.char_js is None and r.word_js is None and r.kept == (not r.base_failed)
            continue
        p, q = shares[r.doc_id]
        rp, rq = reference[rows[r.doc_id].lang]
        assert (r.char_js, r.word_js) == (pytest.approx(js(p, rp), abs=1e-6), pytest.approx(js(q, rq), abs=1e-6))
        assert r.kept == (not r.base_failed and r.char_js + r.word_js <= 0.44)
        seen += 1
    assert seen > 100


def test_cumulative_link_probabilities(docs, spark, sf):  # noqa: F811
    """Scores by a plain sum over features, chances by the definition, and a fit at which the likelihood is stationary in the thresholds."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = ordinal_quality.train(docs, labels)
    hasher = ordinal_quality.Hasher()
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    for r in ordinal_quality.classify(docs, model).collect():
        z = sum(float(model.weights[i]) * v for i, v in zip(*hasher.features(r.text), strict=True))
        below = [sigmoid(t - z) for t in model.thresholds]
        chances = [below[0], below[1] - below[0], 1 - below[1]]
        assert r.tail_prob == pytest.approx(chances[2], abs=1e-4) and r.expected_grade == pytest.approx(chances[1] + 2 * chances[2], abs=1e-4)
        assert r.accepted == (r.tail_prob >= 0.6)
    rng = np.random.default_rng(1)
    rows = [(np.array([0, 1]), np.array([1.0, float(x)])) for x in rng.normal(size=400)]
    grades = np.array([int(v[1] + rng.normal() > -0.5) + int(v[1] + rng.normal() > 1.2) for _, v in rows])
    fitted = ordinal_quality.fit(rows, grades, steps=800)

    def loss(thresholds):
        z = np.array([fitted.weights[i] @ v for i, v in rows])
        p = ordinal_quality.Model(fitted.weights, np.array(thresholds)).chances(z)
        return -np.log(p[np.arange(len(z)), grades]).mean()

    at = loss(fitted.thresholds)
    for k in (0, 1):
        for step in (-0.2, 0.2):
            moved = fitted.thresholds.copy()
            moved[k] += step
            assert loss(moved) > at


def test_spans_by_brute_force(spark, docs):  # noqa: F811
    """All spans: base kinds always, wider kinds where under three repositories and owners hold the value."""
    wide = "0123456789ABCDEF" * 2
    rows = [(i, f"see {wide} and ghp_{'a' * 20}{i} in it", f"s{i}", "x") for i in range(4)] + [(9, "FEDCBA98765432100123456789ABCDEF ghp_short", "s9", "x"), (10, "FEDCBA98765432100123456789ABCDEF", "s9", "y"), (11, None, None, None)]
    made = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    for frame in (made, docs):
        all_ = frame.collect()
        found, held = {}, {}
        for n, r in enumerate(all_):
            found[n] = secret_scan.candidates(r.text or "")
            for x in found[n]:
                value = r.text[x[0] : x[3]].lower() if x[1] != 0 else re.search(r"""[A-Za-z0-9+/_.=-]+\Z""", r.text[x[0] : x[3]])[0].lower()
                held.setdefault(x[4], (set(), set(), set()))
                for k, v in enumerate((f"{r.source}/{r.lang}", r.source, value)):
                    held[x[4]][k].add(v)
        assert all(len(v[2]) == 1 for v in held.values())  # a hash names one value
        want = Counter()
        for n, r in enumerate(all_):
            told = [x for x in found[n] if x[1] < 3 or (len(held[x[4]][0]) < 3 and len(held[x[4]][1]) < 3)]
            want[r.doc_id, ",".join(f"{k}:{s}:{e}" for s, _, k, e, _ in told)] += 1
        got = secret_scan.digest(secret_scan.secret_scan(frame, repo=F.concat_ws("/", "source", "lang"), owner=F.col("source")))
        assert Counter((r.doc_id, r.spans) for r in got.collect()) == want
    assert want != Counter() and not any("upper_hex" in s for (d, s) in Counter((r.doc_id, r.spans) for r in secret_scan.digest(secret_scan.secret_scan(made, repo=F.col("source"), owner=F.col("source"))).collect()) if d < 9)


def test_shards_of_a_target_size(docs):  # noqa: F811
    """Splitting stops at leaves of the target's bytes; each shard is a box: equal texts stay together."""
    total = docs.agg(F.sum(F.octet_length("text") + 8)).first()[0]
    got = sharding.shard(docs, n_shards=None, target_bytes=total // 6).collect()
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    assert len(sizes) == 7 and max(sizes.values()) < 1.5 * total / 7  # one more than six, for what is left by rounding
    at = {}
    for r in got:
        at.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(len(s) == 1 for s in at.values())


def test_stages_on_odd_tables(spark, sf, odd, none):  # noqa: F811
    """Nulls, repeated rows, long texts, clashing columns and no rows at all, through every stage on its own."""
    for name, stage in C.STAGES:
        out = stage(spark, odd, sf)
        rows = out.collect()
        assert rows and stage(spark, none, sf).count() == 0
        if name == "best-fit packing":
            assert {r.doc_id for r in rows} == {r.doc_id for r in odd.collect()}
            continue
        assert out.columns == odd.columns
        texts = {(r.doc_id, r.text) for r in odd.collect()}
        if name != "line dedup":
            assert {(r.doc_id, r.text) for r in rows} <= texts
        else:
            assert len(rows) == odd.count() and {r.doc_id for r in rows} == {d for d, _ in texts}  # none of them is emptied
        if name == "near dedup":
            assert Counter(r.doc_id for r in rows).most_common(1)[0][1] == 1 and None in {r.doc_id for r in rows}
