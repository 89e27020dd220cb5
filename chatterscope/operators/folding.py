"""Near-duplicate folding of short texts: greedy in id order, without a group ever meeting in one task.

By its meaning folding is sequential: a text is a representative unless an earlier one of its group is at most ``most``
bits away, and folds into the nearest earlier representative. The same result comes from sets:

- Equal hashes share their fate, so the first text of each hash of a group stands for it.
- Two of five blocks of the 64 bits are untouched by three flips, so hashes near each other meet under one of ten keys
  of 25 bits and more; a pair that meets under several is taken under the first. That gives the links between different hashes.
- A hash that no undecided smaller one is linked to is a representative, and those it is linked to are not; rounds over
  the links that are left settle the rest. Each round settles at least the first of every linked group; their
  number is the depth of such dependencies, not the number of texts.
- A text that is not a representative takes the nearest linked one with a smaller id. Representatives are more than ``most`` bits
  apart, so at most 672 of them surround a hash, however many texts there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from chatterscope.functions.text import fold_text, pair_hash
from chatterscope.sources.shared import written

#: Start and width of the five blocks; three flips leave two of them as they are.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
MOST = 3


class SimHasher:
    """64-bit SimHash of texts by their character pairs; the pairs' bits are kept between texts."""

    def __init__(self) -> None:
        self.rows: dict[int, int] = {}
        self.bits = np.zeros((1 << 12, 64), np.float32)

    def _row(self, pair: int) -> int:
        row = self.rows[pair] = self.rows.get(pair, len(self.rows))
        if row == len(self.bits):
            self.bits = np.vstack([self.bits, np.zeros_like(self.bits)])
        text = chr(pair & 0xFFFFFFFF) + (chr((pair >> 32) - 1) if pair >> 32 else "")
        self.bits[row] = np.unpackbits(np.frombuffer(pair_hash(text).to_bytes(8, "little"), np.uint8), bitorder="little")
        return row

    def hash(self, norm: str) -> int:
        """Signed, as Spark's longs; by the majority of each bit."""
        if not norm:
            return 0
        codes = np.frombuffer(norm.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        pairs, counts = np.unique(codes[:-1] | codes[1:] + np.uint64(1) << np.uint64(32) if len(codes) > 1 else codes, return_counts=True)
        known = self.rows
        rows = [known[p] if p in known else self._row(p) for p in pairs.tolist()]
        ones = counts.astype(np.float32) @ self.bits[rows] if len(norm) < 1 << 23 else counts.astype(np.float64) @ self.bits[rows]
        return int(np.packbits(2 * ones > counts.sum(), bitorder="little").view(np.int64)[0])


def simhash(text: Column) -> Column:
    """The hash of the folded text; null where fewer than two characters are left."""

    @F.pandas_udf(T.LongType())
    def each(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hasher = SimHasher()
        for s in parts:
            norm = [fold_text(t) for t in s]
            yield pd.Series([hasher.hash(t) if len(t) > 1 else None for t in norm], dtype="Int64")

    return each(text)


def _meeting(h: Column) -> Column:
    block = lambda i: F.shiftrightunsigned(h, BLOCKS[i][0]).bitwiseAND((1 << BLOCKS[i][1]) - 1)
    return F.array(*[F.struct(F.lit(t).alias("t"), F.shiftleft(block(i), 13).bitwiseOR(block(j)).alias("v")) for t, (i, j) in enumerate(combinations(range(5), 2))])


def _first_meeting(x: Column) -> Column:
    """The first key under which two hashes meet; x: their difference."""
    same = [x.bitwiseAND(F.lit(((1 << w) - 1) << s if s + w < 64 else (((1 << w) - 1) << s) - (1 << 64))) == 0 for s, w in BLOCKS]
    out = F.lit(None).cast("int")
    for t, (i, j) in reversed(list(enumerate(combinations(range(5), 2)))):
        out = F.when(same[i] & same[j], t).otherwise(out)
    return out


def _band(x: Column) -> Column:
    """The first of four bands of sixteen bits in which two hashes agree: nearest representatives tie by it before their ids."""
    out = F.lit(3)
    for b in (2, 1, 0):
        out = F.when(F.shiftrightunsigned(x, 16 * b).bitwiseAND(0xFFFF) == 0, b).otherwise(out)
    return out


def links(first: DataFrame, most: int = MOST) -> DataFrame:
    """grp, a, b, ha, hb, x: pairs of different hashes at most ``most`` bits apart, the earlier first. first: grp, hash, id."""
    if not 0 < most <= MOST:
        raise ValueError(f"the keys find up to {MOST} bits")
    keyed = first.select("grp", "id", "hash", F.explode(_meeting(F.col("hash"))).alias("m")).select("grp", "id", "hash", "m.t", "m.v")
    a, b = keyed.select("grp", "t", "v", F.col("id").alias("a"), F.col("hash").alias("ha")), keyed.select("grp", "t", "v", F.col("id").alias("b"), F.col("hash").alias("hb"))
    x = F.col("ha").bitwiseXOR(F.col("hb"))
    near = a.join(b, ["grp", "t", "v"]).where((F.col("a") < F.col("b")) & (F.bit_count(x) <= most) & (_first_meeting(x) == F.col("t")))
    return near.select("grp", "a", "b", "ha", "hb", x.alias("x"))


def settled(pairs: DataFrame) -> DataFrame:
    """grp, id: the linked ones that are no representatives. pairs: grp, a, b with a before b.

    A round: those without an undecided smaller one are representatives, and what they link to is hit. A table a round.
    """
    left, hits = pairs.select("grp", "a", "b"), []
    while True:
        waiting = left.select("grp", F.col("b").alias("a")).distinct().withColumn("waits", F.lit(True))
        at = left.join(waiting, ["grp", "a"], "left")
        at = at.withColumn("hit", F.max(F.col("waits").isNull()).over(W.partitionBy("grp", "b")))
        lost = at.where("hit").select("grp", F.col("b").alias("a")).distinct().withColumn("lost", F.lit(True))
        at = at.join(lost, ["grp", "a"], "left").where(F.col("hit") | (F.col("waits") & F.col("lost").isNull()))
        done = written(at.select("grp", "a", "b", "hit"), "folding")
        hits.append(done.where("hit").select("grp", F.col("b").alias("id")))
        left = done.where("not hit").select("grp", "a", "b")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, hits).distinct()


def fold_hashes(at: DataFrame, most: int = MOST) -> DataFrame:
    """grp, id, rep, distance from grp, id, hash (null: not to be folded)."""
    first = written(at.where("hash is not null").groupBy("grp", "hash").agg(F.min("id").alias("id")), "folding")
    pairs = written(links(first, most), "folding")
    members = settled(pairs).withColumn("member", F.lit(True))
    both = pairs.select("grp", F.col("hb").alias("hash"), F.col("a").alias("other"), "x").unionByName(pairs.select("grp", F.col("ha").alias("hash"), F.col("b").alias("other"), "x"))
    near = both.join(members.select("grp", F.col("id").alias("other")), ["grp", "other"], "left_anti")
    near = near.groupBy("grp", "hash").agg(F.collect_list(F.struct(F.bit_count("x").cast("long").alias("distance"), _band(F.col("x")).alias("band"), F.col("other").alias("rep"))).alias("near"))
    fate = first.join(members, ["grp", "id"], "left").join(near, ["grp", "hash"], "left").select("grp", "hash", F.col("id").alias("first"), F.coalesce("member", F.lit(False)).alias("member"), "near")
    out = at.join(fate, ["grp", "hash"], "left")
    nearest = F.array_min(F.filter("near", lambda r: r["rep"] < F.col("id")))
    rep = F.when(F.col("member"), nearest["rep"]).otherwise(F.coalesce("first", "id"))
    distance = F.when(F.col("member"), nearest["distance"]).when(F.col("first") < F.col("id"), F.lit(0).cast("long"))
    return out.select("grp", "id", rep.alias("rep"), distance.alias("distance"))


def folded(rows: DataFrame, keys: list[str], id_col: str, text_col: str, most: int = MOST) -> DataFrame:
    """keys, id, rep, distance for each row: itself and null for representatives and texts too short to fold. Ids are unique in a group; null keys are a group."""
    at = written(rows.select(F.struct(*keys).alias("grp"), F.col(id_col).alias("id"), simhash(F.col(text_col)).alias("hash")), "folding")
    return fold_hashes(at, most).select(*[F.col("grp")[k].alias(k) for k in keys], F.col("id").alias(id_col), "rep", "distance")
