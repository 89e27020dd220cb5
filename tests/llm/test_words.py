"""Words are hashed by arrays, a piece of a text at a time, and are equal exactly where their letters are."""

import sys

import pandas as pd
import pytest

from chatterscope.llm import near_dup
from tests.llm.test_memory import Store


def calls(run):
    """Calls of functions, Python's and C's."""
    seen = 0

    def count(frame, event, arg):
        nonlocal seen
        seen += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        run()
    finally:
        sys.setprofile(None)
    return seen


def test_sketching_makes_no_call_a_word(spark):
    store = Store()
    near_dup.sketches(type("Docs", (), {"select": lambda self, *c: store})(), 5)
    few, many = (pd.DataFrame({"doc_id": [1], "text": [" ".join(f"w{i}" for i in range(n))]}) for n in (1_000, 50_000))
    list(store.each([few]))
    assert calls(lambda: list(store.each([many]))) < calls(lambda: list(store.each([few]))) + 2_000


@pytest.mark.parametrize("piece", [1 << 16, 16])
def test_words_are_equal_where_their_letters_are(piece, monkeypatch):
    monkeypatch.setattr(near_dup, "PIECE", piece)
    texts = ["", " ", "\n\t\x0b", "a", "A a", " ab ba AB\x1cab ab", "x" * 40 + " y " + "x" * 40, "é ß É \x00 \x00\x00 a\x00 a", "aaab abaa baaa aaba " * 9, "z" * 70_000 + " z\rz" + "z" * 69_999, "one two three " * 30]
    names = {}
    for text in texts:
        found, hashes = text.encode().lower().split(), near_dup.words(text).tolist()
        assert len(found) == len(hashes)
        assert all(names.setdefault(w, h) == h for w, h in zip(found, hashes, strict=True))
    assert len(set(names.values())) == len(names)
    assert not len(near_dup.words(None))
