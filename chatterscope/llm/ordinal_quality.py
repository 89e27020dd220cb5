"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A document's grade is how many good properties its rating has: quality 1 and toxic 0 give 2, one of them 1, none 0.
One weight vector over hashed text features is shared by all grades, ordered thresholds t1 < t2 divide its score:
P(grade <= k) = sigmoid(t_k+1 - w.x). The expected grade and the tail probability P(grade = 2) follow for every
document; those with a tail probability under ``min_tail`` are rejected.

Features: lower-cased words (presence damped by log1p of their count), word shapes (share of the words) and
the texture of the word sequence (share of distinct words, immediate repeats), hashed.
The fit uses at most ``max_fit_rows`` rated documents, those of smallest hash of the id; that bound is the only
limit, scoring covers every whole text.

Defined cases: a null or empty text has no features and gets the thresholds' own probabilities; ratings with nulls
are not used; an id rated twice counts with its lowest grade; an id that repeats in the documents is scored each
time; without ratings nothing is rejected and the scores are null; further columns are passed through, but for
columns named expected_grade, tail_prob or accepted, which are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD_BITS, SHAPE_BITS, GRADES = 18, 12, 3
EDGES = ".,;:!?\"'()[]{}|#*$%&<>-"
_UPPER, _LOWER, _DIGIT = re.compile(r"[^\W\d_a-zß-öø-ÿ]+"), re.compile(r"[a-zß-öø-ÿ]+"), re.compile(r"\d+")
CACHED = 400_000


def _bucket(name: str) -> int:
    return zlib.crc32(name.encode()) >> (32 - SHAPE_BITS)


class Hasher(dict):
    """Word -> hashed word and hashed shape in one number; a memory that is emptied when it is full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED:
            self.clear()
        shape = _DIGIT.sub("0", _UPPER.sub("A", _LOWER.sub("a", word)))
        core = word.lower().strip(EDGES) or word
        out = (zlib.crc32(core.encode("utf-8", "replace")) >> (32 - WORD_BITS)) << SHAPE_BITS | zlib.crc32(shape.encode("utf-8", "replace")) >> (32 - SHAPE_BITS)
        if len(word) < 60:
            self[word] = out
        return out

    def features(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Indices and values: shapes stand above the words."""
        words = text.split() if text else []
        if not words:
            return np.zeros(0, np.int64), np.zeros(0)
        both = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        w, nw = np.unique(both >> SHAPE_BITS, return_counts=True)
        s, ns = np.unique(both & ((1 << SHAPE_BITS) - 1), return_counts=True)
        repeats = float((both[1:] == both[:-1]).mean()) if len(both) > 1 else 0.0
        texture = np.array([_bucket(f"rare:{10 * len(w) // len(both)}"), _bucket("repeats"), _bucket("bias")]) + (1 << WORD_BITS)
        return np.concatenate([w, s + (1 << WORD_BITS), texture]), np.concatenate([np.log1p(nw), 10.0 * ns / len(words), [1.0, 10 * repeats, 1.0]])


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, index: np.ndarray, value: np.ndarray) -> float:
        return float(self.weights[index] @ value)

    def chances(self, z: np.ndarray) -> np.ndarray:
        """P(grade = k) by column."""
        below = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - z[:, None], -30, 30)))
        edges = np.hstack([np.zeros((len(z), 1)), below, np.ones((len(z), 1))])
        return np.diff(edges, axis=1)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, steps: int = 150, l2: float = 2e-3) -> Model:
    """Full-batch Adam on the cumulative-link likelihood; every feature is scaled by how surely its rates in low and high grades differ."""
    dim = (1 << WORD_BITS) + (1 << SHAPE_BITS)
    index = np.concatenate([r[0] for r in rows]) if rows else np.zeros(0, np.int64)
    value = np.concatenate([r[1] for r in rows]) if rows else np.zeros(0)
    n_rows = len(rows)
    row = np.repeat(np.arange(n_rows, dtype=np.int32), [len(r[0]) for r in rows])
    seen = np.bincount(index, minlength=dim)
    top = grades == GRADES - 1
    n_good, n_bad = int(top.sum()) + 1, int((~top).sum()) + 1
    good = np.bincount(index, weights=top[row], minlength=dim) / n_good
    bad = np.bincount(index, weights=~top[row], minlength=dim) / n_bad
    rate = np.clip(seen / (n_good + n_bad), 1e-9, 0.999)
    z = np.abs(bad - good) / np.sqrt(rate * (1 - rate) * (1 / n_good + 1 / n_bad))
    scale = np.where(seen >= 3, 0.01 + (z / 5) ** 2, 0.0)
    x = value * scale[index]
    share = np.clip([(grades <= k).mean() for k in range(GRADES - 1)], 1e-3, 1 - 1e-3)
    th = np.log(share / (1 - share))
    p = np.concatenate([np.zeros(dim), [th[0], np.log(max(th[1] - th[0], 1e-3))]])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for i in range(1, steps + 1):
        w, t1 = p[:dim], p[dim]
        gap = np.exp(p[dim + 1])
        z = np.bincount(row, weights=w[index] * x, minlength=n_rows)
        s1, s2 = (1 / (1 + np.exp(-np.clip(t - z, -30, 30))) for t in (t1, t1 + gap))
        lo = np.where(grades == 0, 0.0, np.where(grades == 1, s1, s2))
        hi = np.where(grades == 0, s1, np.where(grades == 1, s2, 1.0))
        like = np.maximum(hi - lo, 1e-9)
        d_hi, d_lo = hi * (1 - hi) / like, lo * (1 - lo) / like
        g = np.zeros_like(p)
        g[:dim] = np.bincount(index, weights=(d_hi - d_lo)[row] * x, minlength=dim) / n_rows + l2 * w
        g[dim] = -(d_hi - d_lo).mean()
        g[dim + 1] = -gap * (np.where(grades == 1, d_hi, 0.0) - np.where(grades == 2, d_lo, 0.0)).mean()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= 0.05 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    return Model(p[:dim] * scale, np.array([p[dim], p[dim] + np.exp(p[dim + 1])]))


def rated(labels: DataFrame, max_fit_rows: int) -> DataFrame:
    grade = (F.col("quality") + 1 - F.col("toxic")).cast("int")
    each = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min(grade).alias("grade"))
    return each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_fit_rows)


def train(docs: DataFrame, labels: DataFrame, max_fit_rows: int = 6_000) -> Model | None:
    """The model, fitted on the driver on at most ``max_fit_rows`` rated documents."""
    chosen = rated(labels, max_fit_rows)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text"))  # of an id with several texts the least

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for pdf in parts:
            both = [hasher.features(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "grade": pdf["grade"], "i": [b[0].astype(np.int32).tobytes() for b in both], "v": [b[1].astype(np.float32).tobytes() for b in both]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = sorted(found.mapInPandas(read, f"doc_id {kind}, grade int, i binary, v binary").toLocalIterator(), key=lambda r: r["doc_id"])
    if not rows:
        return None
    return fit([(np.frombuffer(r["i"], np.int32), np.frombuffer(r["v"], np.float32)) for r in rows], np.array([r["grade"] for r in rows]))


def classify(docs: DataFrame, model: Model | None, min_tail: float = 0.6) -> DataFrame:
    """All columns of docs and expected_grade, tail_prob, accepted."""
    if model is None:
        return docs.withColumns({"expected_grade": F.lit(None).cast("double"), "tail_prob": F.lit(None).cast("double"), "accepted": F.lit(True)})
    weights, thresholds = model.weights.astype(np.float32), model.thresholds
    shared = docs.sparkSession.sparkContext.broadcast((weights, thresholds))  # 2^18 + 2^12 numbers, whatever the input

    @F.pandas_udf(T.StructType([T.StructField("expected_grade", T.DoubleType()), T.StructField("tail_prob", T.DoubleType())]))
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own, hasher = Model(*shared.value), Hasher()
        for texts in parts:
            z = np.array([own.score(*hasher.features(t)) for t in texts])
            chance = own.chances(z) if len(z) else np.zeros((0, GRADES))
            yield pd.DataFrame({"expected_grade": chance @ np.arange(GRADES), "tail_prob": chance[:, -1]})

    out = docs.withColumn("__oq", scored("text"))
    return out.withColumns({"expected_grade": F.col("__oq.expected_grade"), "tail_prob": F.col("__oq.tail_prob"), "accepted": F.col("__oq.tail_prob") >= min_tail}).drop("__oq")
