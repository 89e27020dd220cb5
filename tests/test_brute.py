"""Queries without SQL against plain Python on the smallest tables."""

import hashlib
import math
import re
import unicodedata
from collections import Counter

from chatterscope.functions import text as X
from chatterscope.plans import catalog


def documents(spark, sf):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_sentences(spark, sf):
    """Sentences end behind runs of end marks, or a point before a blank; the index is that of the last one that has begun."""
    docs = documents(spark, sf)
    for r in catalog.QUERIES["f46_sentence_spans"](spark, sf).collect():
        found, at = [], 0
        text = docs[r.doc_id].text
        for piece in re.split(r"(?<=[。！？!?；;\n])(?![。！？!?；;\n])|(?<=\.)(?=\s|$)", text):
            if piece.strip():
                found.append((at, at + len(piece)))
            at += len(piece)
        assert r.sentences == len(found)
        inside = [i for i, (a, b) in enumerate(found) if a <= 100 < b]
        if inside:
            assert r.at_100 == inside[0]


def test_maximal_names(spark, sf):
    names = {"the": "1", "other": "2", "other one": "3", "tion": "4", "nation": "5"}
    docs = documents(spark, sf)
    for r in catalog.QUERIES["f47_maximal_names"](spark, sf).collect():
        text = docs[r.doc_id].text
        spans = [(i, i + len(n), c) for n, c in names.items() for i in range(len(text)) if text.startswith(n, i)]
        want = {c for a, b, c in spans if not any(x <= a and b <= y and y - x > b - a for x, y, _ in spans)}
        assert r.codes == ",".join(sorted(want))


def test_folding(spark, sf):
    """Greedy in id order: to a nearest representative at most three bits away, by a hash written out bit by bit."""

    def simhash(text):
        pairs = [text[i : i + 2] for i in range(len(text) - 1)]
        hashes = [int.from_bytes(hashlib.blake2b(p.encode(), digest_size=8).digest(), "big") for p in pairs]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    docs = documents(spark, sf)
    got = {r.doc_id: (r.rep, r.distance) for r in catalog.QUERIES["v10_f53_near_dup_folding"](spark, sf).collect()}
    assert set(got) == set(docs)
    reps, hashes = {}, {}
    for d in sorted(docs):
        norm = X.fold_text(docs[d].text)
        if len(norm) < 2:
            assert got[d] == (d, None)
            continue
        key, hashes[d] = (docs[d].lang, d % 7), simhash(norm)
        near = {r: (hashes[d] ^ hashes[r]).bit_count() for r in reps.get(key, [])}
        least = min(near.values(), default=64)
        if least <= 3:
            assert got[d][1] == least and near[got[d][0]] == least
        else:
            assert got[d] == (d, None)
            reps.setdefault(key, []).append(d)


def test_batches(spark, sf):
    rows = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        rows.setdefault(r.conv_id, []).append((r.turn, r.text))
    want = Counter()
    for conv, turns in rows.items():
        batch, held = 0, []
        for turn, text in sorted(turns):
            tokens = lambda ts: math.ceil(sum(1.6 if ord(c) > 127 else 0.34 for t in ts for c in t) * 1.15 - 1e-9)
            size = lambda ts: sum(len(t.encode()) for t in ts)
            if held and (len(held) == 3 or tokens([*held, text]) > 800 or size([*held, text]) > 6000):
                batch, held = batch + 1, []
            alone = tokens([text]) > 800 or size([text]) > 6000
            want[conv, turn, -1 if alone else batch] += 1
            held += [] if alone else [text]
    assert Counter(tuple(r) for r in catalog.QUERIES["v15_batch_packing"](spark, sf).collect()) == want


def test_quotes(spark, sf):
    docs = documents(spark, sf)
    kinds = set()
    for r in catalog.QUERIES["f52_quotes_in_texts"](spark, sf).collect():
        text = docs[r.doc_id].text
        kinds.add(r.method)
        bare = lambda t: re.sub(r"\s+", "", unicodedata.normalize("NFKC", t)).lower()
        if r.method == "exact":
            assert text.find(r.quote) == r.start and text[r.start : r.end] == r.quote
        elif r.method == "normalized":
            assert r.quote not in text and bare(text[r.start : r.end]) == bare(r.quote) and bare(text).find(bare(r.quote)) == len(bare(text[: r.start]))
        else:
            assert not bare(r.quote) or bare(r.quote) not in bare(text)
    assert {"exact", "normalized"} <= kinds
