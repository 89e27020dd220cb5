"""Names of a dictionary in texts: one automaton over all names reads a text once, however many names there are."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A dictionary goes to every worker whole, so its size is checked: beyond this it is a corpus, and wants a join.
MOST_NAMES = 1_000_000


def automaton(names: dict[str, str]) -> ahocorasick.Automaton:
    """Empty names are never found."""
    out = ahocorasick.Automaton()
    for name, code in names.items():
        if name:
            out.add_word(name, (len(name), code))
    out.make_automaton()
    return out


def occurrences(text: str, found: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, code) of every name at every place, by start, longer ones first."""
    if not len(found):
        return []
    return sorted(((end + 1 - n, end + 1, code) for end, (n, code) in found.iter(text)), key=lambda s: (s[0], -s[1]))


def codes(text: str, found: ahocorasick.Automaton, maximal: bool) -> list[str]:
    """Codes of the names in a text, in code order; ``maximal`` leaves out places inside a longer name's."""
    out, reach = set(), -1
    for _, end, code in occurrences(text, found):
        if end > reach or not maximal:
            out.add(code)
        reach = max(reach, end)
    return sorted(out)


def name_codes(text: Column, names: dict[str, str], maximal: bool = True) -> Column:
    """Codes of the names found in a text; a null text has none. names: code by name, exact in case."""
    if len(names) > MOST_NAMES:
        raise ValueError(f"{len(names)} names: more than a dictionary of {MOST_NAMES}")

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def each(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        found = automaton(names)  # once a task
        for s in parts:
            yield s.map(lambda t: codes(t, found, maximal) if t else [])

    return each(text)


def collected(names: DataFrame) -> dict[str, str]:
    """A dictionary from a table (name, code); the least code where a name has several. Its size is checked before it is collected."""
    rows = names.where("name is not null and name <> ''").groupBy("name").agg(F.min("code").alias("code")).limit(MOST_NAMES + 1).collect()
    if len(rows) > MOST_NAMES:
        raise ValueError(f"more than a dictionary of {MOST_NAMES} names")
    return {r["name"]: r["code"] for r in rows}
