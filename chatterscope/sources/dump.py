"""Reading SQL dumps: ``read_dump(spark, path, table, columns)``.

A dump's INSERT statements each stand on one line. Lines are read by Spark's text reader, so a file is split like any
other; tuples are cut in Arrow batches. Only the wanted table's lines are decoded; a filter sees raw fields before
strings are unescaped. A wrong number of columns or an open string is an error, never a skipped row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FIELD = re.compile(r"'((?:[^'\\]|\\.|'')*)'|([^,()']+)")
_ESCAPE = re.compile(r"\\(.)|''", re.DOTALL)
#: MySQL's escapes; those of LIKE patterns stand for both their characters.
_PLAIN = {"n": "\n", "r": "\r", "t": "\t", "0": "\0", "b": "\b", "Z": "\x1a", "%": "\\%", "_": "\\_"}


def unescaped(raw: str) -> str:
    return _ESCAPE.sub(lambda m: "'" if m[1] is None else _PLAIN.get(m[1], m[1]), raw) if "\\" in raw or "''" in raw else raw


def tuples(line: str, columns: int) -> Iterator[list[tuple[bool, str]]]:
    """Each tuple as (is string, raw) fields."""
    at = line.find("VALUES") + len("VALUES")
    while True:
        at = line.find("(", at)
        if at < 0:
            return
        fields, at = [], at + 1
        while True:
            m = _FIELD.match(line, at)
            if m is None:
                raise ValueError(f"open string or empty field at {at}: {line[at : at + 40]!r}")
            fields.append((m[1] is not None, m[1] if m[1] is not None else m[2].strip()))
            at = m.end()
            if at >= len(line):
                raise ValueError("the tuple is not closed")
            at += 1
            if line[at - 1] == ")":
                break
            if line[at - 1] != ",":
                raise ValueError(f"unexpected {line[at - 1]!r} at {at - 1}")
        if len(fields) != columns:
            raise ValueError(f"{len(fields)} columns, {columns} expected")
        yield fields


def read_dump(spark: SparkSession, path: str, table: str, columns: list[str], keep: Callable[[dict[str, str]], bool] | None = None) -> DataFrame:
    """The table's rows as strings; NULL is null, 'NULL' is a string."""
    return dump_rows(spark.read.text(path), table, columns, keep)


def dump_rows(text: DataFrame, table: str, columns: list[str], keep: Callable[[dict[str, str]], bool] | None = None) -> DataFrame:
    """text: value, the dump's lines."""
    lines = text.where(F.col("value").startswith(f"INSERT INTO `{table}`"))

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for line in pdf["value"]:
                for fields in tuples(line, len(columns)):
                    if keep is None or keep({c: v for c, (_, v) in zip(columns, fields, strict=True)}):
                        rows.append([unescaped(v) if text else None if v.upper() == "NULL" else v for text, v in fields])
            yield pd.DataFrame(rows, columns=columns, dtype=object)

    return lines.mapInPandas(each, ", ".join(f"`{c}` string" for c in columns))


def import_posts(posts: DataFrame, stocks: DataFrame, pool: list[str], cutoff: str) -> DataFrame:
    """Second pass: posts of pool stocks from the cutoff on; a pool product the dump does not know is an error when rows are read."""
    wanted = stocks.where(F.col("code").isin(pool)).select("stock_id", "code")
    missing = F.array_except(F.array(*map(F.lit, pool)), F.collect_set("code"))
    gate = wanted.agg(F.when(F.size(missing) > 0, F.raise_error(F.concat(F.lit("products missing in the dump: "), F.array_join(F.array_sort(missing), ", "))).cast("boolean")).otherwise(True).alias("_known"))
    wanted = F.broadcast(wanted.crossJoin(F.broadcast(gate)).where("_known").select("stock_id"))  # at most the pool's size
    return posts.where(F.col("posted_at") >= cutoff).join(wanted, "stock_id", "left_semi")
