"""Values out of cut JSON, stocks out of free text, and catalog scripts: work on one string at a time, in Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r'\s*(?:([{}\[\],:])|("(?:[^"\\]|\\.)*")|(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)(?=[\s,}\]])|(true|false|null)(?=[\s,}\]]))')


def events(text: str) -> Iterator[tuple[str, str, object]]:
    """(path, kind, value) as far as the text is whole; kind is number, other or close."""
    path: list[str] = []
    stack: list[str] = []
    at, key, wants_key = 0, "", False
    while m := _TOKEN.match(text, at):
        at = m.end()
        mark, string, number, word = m.groups()
        here = ".".join(p for p in [*path, key] if p)
        if mark in ("{", "["):
            path.append(key)
            stack.append(mark)
            key, wants_key = ("", True) if mark == "{" else ("item", False)
        elif mark in ("}", "]"):
            if not stack:
                return
            stack.pop()
            key = path.pop()
            if mark == "}":
                yield ".".join(p for p in [*path, key] if p), "close", None
        elif mark == ",":
            wants_key = bool(stack) and stack[-1] == "{"
            key = "" if wants_key else "item"
        elif mark == ":":
            wants_key = False
        elif string is not None and wants_key:
            key = json.loads(string)
        else:
            yield here, "number" if number is not None else "other", float(number) if number is not None else string or word


def recovered(text: str | None, paths: tuple[str, ...]) -> int | None:
    """The counter at one of the paths: all seen must agree, be whole and not negative, and one enclosing object be closed."""
    found: dict[str, int] = {}
    closed = set()
    for path, kind, value in events(text or ""):
        if kind == "close":
            closed.add(path)
        elif path in paths:
            if path in found or kind != "number" or value < 0 or value != int(value):
                return None
            found[path] = int(value)
    whole = any(p.rpartition(".")[0] in closed for p in found)
    return next(iter(found.values())) if whole and len(set(found.values())) == 1 else None


def recovered_counter(text: Column, paths: tuple[str, ...]) -> Column:
    @F.pandas_udf(T.LongType())
    def each(s: pd.Series) -> pd.Series:
        return s.map(lambda t: recovered(t, paths)).astype("Int64")

    return each(text)


class Stocks:
    """Stocks named in a text: other scripts as substrings, Latin words at word edges, codes unless they look like years."""

    def __init__(self, names: dict[str, str]):
        names = {k.lower(): v for k, v in names.items()}
        self.codes = {k: v for k, v in names.items() if re.fullmatch(r"\d{4,5}(\.hk)?", k)}
        words = {k: v for k, v in names.items() if k not in self.codes}
        self.latin = {k: v for k, v in words.items() if k.isascii()}
        self.other = {k: v for k, v in words.items() if not k.isascii()}
        self.word = re.compile("(?<![a-z0-9])(?:" + "|".join(map(re.escape, sorted(self.latin, key=len, reverse=True))) + ")(?![a-z0-9])") if self.latin else None

    def of(self, text: str | None, ignore: frozenset[str] = frozenset()) -> list[str]:
        low = (text or "").lower()
        found = {v for k, v in self.other.items() if k in low and k not in ignore}
        if self.word:
            found |= {self.latin[w] for w in self.word.findall(low) if w not in ignore}
        for number, suffix in re.findall(r"(?<![0-9.])(0?\d{4})(\.hk)?(?![0-9])", low):
            year = not suffix and len(number) == 4 and 1990 <= int(number) <= 2040
            keys = [number + suffix, number.zfill(5) + suffix, number, number.zfill(5)]
            hit = next((self.codes[k] for k in keys if k in self.codes), None)
            if hit and not year and number.lstrip("0") not in ignore:
                found.add(hit)
        return sorted(found)


def stocks(text: Column, names: dict[str, str]) -> Column:
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def each(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Stocks(names)
        for s in parts:
            yield s.map(known.of)

    return each(text)


def jsonp_rows(scripts: DataFrame, column: str, schema: str) -> DataFrame:
    """Rows of callback({... "data": [...]}) scripts, exploded under a schema."""
    body = F.regexp_extract(column, r"(?s)^[^(]*\((.*)\)\s*;?\s*$", 1)
    return scripts.select(F.explode(F.from_json(body, f"struct<data:array<{schema}>>")["data"]).alias("r")).select("r.*")


def merged_catalog(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row a key: the first non-blank value by seq, and how many different ones there were."""
    value = lambda c: F.nullif(F.trim(c), F.lit(""))
    return rows.groupBy(key).agg(*[F.min_by(value(c), F.when(value(c).isNotNull(), F.col("seq"))).alias(c) for c in fields], *[F.count_distinct(value(c)).alias(f"{c}_values") for c in fields])


def treemap(rows: DataFrame, group: str, name: str, weight: str, width: float = 100.0, height: float = 100.0) -> DataFrame:
    """Squarified layout per group: x, y, w, h of each positive row. A group is one picture, so small."""

    def worst(row: list[float], side: float) -> float:
        total = sum(row)
        return max(max(side * side * r / (total * total), total * total / (side * side * r)) for r in row)

    def layout(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf[weight] > 0].sort_values([weight, name], ascending=[False, True])
        area = pdf[weight] * (width * height / pdf[weight].sum()) if len(pdf) else pdf[weight]
        left, out = list(area), []
        x, y, w, h = 0.0, 0.0, width, height
        while left:
            row = [left.pop(0)]
            side = min(w, h)
            while left and worst([*row, left[0]], side) <= worst(row, side):
                row.append(left.pop(0))
            thick, at = sum(row) / side, 0.0
            for a in row:
                out.append((x, y + at, thick, a / thick) if w >= h else (x + at, y, a / thick, thick))
                at += a / thick
            x, y, w, h = (x + thick, y, w - thick, h) if w >= h else (x, y + thick, w, h - thick)
        return pd.DataFrame({group: pdf[group].to_numpy(), name: pdf[name].to_numpy(), **{k: [o[i] for o in out] for i, k in enumerate("xywh")}})

    kinds = dict(rows.dtypes)
    return rows.select(group, name, weight).groupBy(group).applyInPandas(layout, f"{group} {kinds[group]}, {name} {kinds[name]}, x double, y double, w double, h double")
