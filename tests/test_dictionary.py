"""A dictionary's names in texts against a search name by name."""

import random

import pytest
from pyspark.sql import functions as F

from chatterscope.functions import text as X
from chatterscope.operators import dictionary as D


def plain(text, names, maximal):
    spans = [(i, i + len(n), c) for n, c in names.items() if n for i in range(len(text)) if text.startswith(n, i)]
    return sorted({c for a, b, c in spans if not maximal or not any(x <= a and b <= y and y - x > b - a for x, y, _ in spans)})


@pytest.mark.parametrize("maximal", [True, False])
def test_random_names(maximal):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("ab费 ") for _ in range(n))
    for _ in range(300):
        names = {word(rng.randint(0, 5)): str(rng.randint(0, 9)) for _ in range(rng.randint(0, 12))}
        text = word(rng.randint(0, 40))
        assert D.codes(text, D.automaton(names), maximal) == plain(text, names, maximal)
        if maximal:
            assert D.codes(text, D.automaton(names), True) == X.maximal_names(text, names)


def test_fifty_thousand_names(spark, sf):
    """The texts' own phrases among fifty thousand names; one pass over the texts."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rng, names = random.Random(2), {}
    for text in texts.values():
        words = text.split(" ")
        for _ in range(3):
            i = rng.randrange(len(words))
            names[" ".join(words[i : i + rng.randint(1, 3)])] = f"c{len(names)}"
    while len(names) < 50_000:
        names["".join(rng.choice("abcdefghijklmnop") for _ in range(14))] = f"c{len(names)}"
    got = {r.doc_id: r.codes for r in docs.select("doc_id", D.name_codes(F.col("text"), names).alias("codes")).collect()}
    for d in sorted(texts)[:40]:
        near = {n: c for n, c in names.items() if n in texts[d]}
        assert got[d] == plain(texts[d], near, True)
    assert sum(map(len, got.values())) > len(texts)


def test_cases(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a fund")], "id long, t string")
    assert [r.c for r in df.orderBy("id").select(D.name_codes(F.col("t"), {"fund": "x", "": "y"}).alias("c")).collect()] == [[], [], ["x"]]
    assert [r.c for r in df.orderBy("id").select(D.name_codes(F.col("t"), {}).alias("c")).collect()] == [[], [], []]
    table = spark.createDataFrame([("a", "2"), ("a", "1"), (None, "3"), ("", "4")], "name string, code string")
    assert D.collected(table) == {"a": "1"}
    with pytest.raises(ValueError, match="more than a dictionary"):
        D.name_codes(F.col("t"), dict.fromkeys(range(D.MOST_NAMES + 1), "x"))
