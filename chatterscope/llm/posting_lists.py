"""Approximate nearest neighbours by balanced posting lists.

Centroids of a balanced k-means over a bounded sample stay in memory, joined by a neighbour graph that is searched
best-first. Every vector goes to the list of its nearest centroid and, near a boundary, to further lists, at most
``max_replicas`` in all: those whose centroid is at most ``1 + replica_slack`` times as far as the nearest. A query reads the lists whose centroids are at most ``ratio`` times as far as
its nearest (at least ``min_lists``), so easy queries read few; the ratio is the one that finds ``recall`` of the
neighbours within the sample, replicas counted. Lists longer than ``chunk_rows`` are cut by a
hash of the id and their chunks searched apart: however many vectors one list holds, no task holds more. Rows are routed
a few at a time and leave the task in small frames, so it holds as little where there are many centroids and lists to read.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite components take
no part, nor do rows without an id; ties go to the smaller id; rows of one id count as one candidate at its
nearest vector; with fewer than k candidates all are given; a table without valid rows gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chatterscope.llm.common import Scratch


#: Distances that a task holds at once while it routes, and rows in a frame that it gives out; pairs that are compared at once.
CELLS, FRAME, PAIRS = 1_000_000, 4_096, 1 << 16


def least(d: np.ndarray, k: int) -> np.ndarray:
    """The columns of each row's k least values, in any order."""
    return np.argpartition(d, k - 1, axis=1)[:, :k] if k < d.shape[1] else np.tile(np.arange(d.shape[1]), (len(d), 1))


class Centroids:
    """Centroids and a graph over them."""

    def __init__(self, points: np.ndarray, degree: int = 24):
        self.points = points.astype(np.float32)
        n = len(points)
        self.graph = np.zeros((n, min(degree, max(n - 1, 1))), np.int32)
        for at in range(0, n, 512):
            d = self.far(self.points[at : at + 512], self.points)
            d[np.arange(len(d)), at + np.arange(len(d))] = np.inf
            self.graph[at : at + 512] = least(d, self.graph.shape[1])
        step = max(1, n // 16)
        self.entries = np.arange(0, n, step)[:16]

    @staticmethod
    def far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0)

    def search(self, x: np.ndarray, beam: int, within: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroids found for each row: (ids, distances), nearest first.

        Best-first over the graph for all rows at once: each round opens the sixteen nearest centroids not yet opened,
        until the ``beam`` nearest are all open, or those of them at most ``within`` times as far as the nearest.
        """
        n = len(self.points)
        beam = min(beam, n)
        d = np.full((len(x), n), np.inf, np.float32)
        d[:, self.entries] = self.far(x, self.points[self.entries])
        opened = np.zeros((len(x), n), bool)
        live = np.arange(len(x))
        norms = (self.points * self.points).sum(1)
        while len(live):
            near = least(d[live], beam) if beam < n else None
            at = live if near is None else (live[:, None], near)
            cost = np.where(opened[at], np.inf, d[at])
            if within is not None:
                cost = np.where(cost <= within * within * d[live].min(axis=1)[:, None] + 1e-12, cost, np.inf)
            best = least(cost, min(16, beam))
            todo = np.isfinite(np.take_along_axis(cost, best, 1))
            going = todo.any(1)
            live, best, todo = live[going], best[going], todo[going]
            if not len(live):
                break
            open_now = best if near is None else np.take_along_axis(near[going], best, 1)
            rows = np.repeat(live, open_now.shape[1])[todo.ravel()]
            nodes = open_now.ravel()[todo.ravel()]
            opened[rows, nodes] = True
            r, c = np.repeat(rows, self.graph.shape[1]), self.graph[nodes].ravel()
            new = np.isinf(d[r, c])
            r, c = r[new], c[new]
            d[r, c] = np.maximum(norms[c] + (x[r] * x[r]).sum(1) - 2 * np.einsum("ij,ij->i", x[r], self.points[c]), 0)
        ids = least(d, beam)
        ids = np.take_along_axis(ids, np.argsort(np.take_along_axis(d, ids, 1), axis=1), 1)
        return ids, np.sqrt(np.take_along_axis(d, ids, 1))


def balanced_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Lloyd's rounds in which a cluster's size so far adds to its distance, so that sizes come out near equal."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    k = min(k, len(x))
    points = x[rng.choice(len(x), k, replace=False)].copy()
    penalty = np.zeros(k, np.float32)
    for _ in range(rounds):
        own = np.concatenate([np.argmin(Centroids.far(x[i : i + 4096], points) + penalty, axis=1) for i in range(0, len(x), 4096)])
        size = np.bincount(own, minlength=k)
        sums = np.zeros_like(points)
        np.add.at(sums, own, x)
        points = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], points).astype(np.float32)
        spread = float(np.mean(((x - points[own]) ** 2).sum(1)))
        penalty += (0.05 * spread * (size * k / len(x) - 1)).astype(np.float32)
    return points


def held_in(known: Centroids, v: np.ndarray, slack: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, which of them take it) for each vector: its nearest, and up to ``most`` in all that are nearly as near."""
    ids, far = known.search(v, 8 * most)
    ids, far = ids[:, :most], far[:, :most]
    return ids, far <= (1 + slack) * far[:, :1] + 1e-12


def needed_ratio(x: np.ndarray, known: Centroids, k: int, recall: float, slack: float, most: int, seed: int = 9) -> float:
    """How many times as far as the nearest a centroid may be so that lists hold ``recall`` of the k nearest, in any list that has them.

    Measured on up to 400 rows of the sample among the sample: their neighbours there are farther than in all rows,
    so the ratio errs on the safe side.
    """
    rng = np.random.default_rng(seed)
    asks = rng.choice(len(x), min(400, len(x)), replace=False)
    ratios = []
    for at in range(0, len(asks), 50):
        q = asks[at : at + 50]
        d = Centroids.far(x[q], x)
        d[np.arange(len(q)), q] = np.inf
        near = np.argpartition(d, min(k, len(x) - 1) - 1, axis=1)[:, :k] if len(x) > 1 else np.zeros((len(q), 1), int)
        to = np.sqrt(Centroids.far(x[q], known.points))
        ids, take = held_in(known, x[near.ravel()], slack, most)
        held = np.where(take, to[np.repeat(np.arange(len(q)), near.shape[1])[:, None], ids], np.inf).min(axis=1).reshape(near.shape)
        ratios.append((held / np.maximum(to.min(axis=1, keepdims=True), 1e-12)).ravel())
    return float(np.quantile(np.concatenate(ratios), recall))


def nearest(x: np.ndarray, own: np.ndarray, v: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, distance) of each query's k nearest ids, without its own; rows of one id count as one at its nearest.

    Products choose rows, with room for their rounding; distances of those are summed from the differences.
    """
    order = np.argsort(own, kind="stable")
    x, own = x[order], own[order]
    with np.errstate(over="ignore", invalid="ignore"):
        size = (v * v).sum(1)[:, None] + (x * x).sum(1)
        d = size - 2 * v @ x.T
        wild = ~np.isfinite(d)  # squares beyond all numbers: the differences may have some
        other = own != q[:, None]
        d[wild | ~other] = np.inf
        each = np.minimum.reduceat(d, np.flatnonzero(np.append(True, own[1:] != own[:-1])), axis=1)
        bar = np.partition(each, k - 1, axis=1)[:, k - 1 : k] if each.shape[1] > k else np.inf
        r, c = np.nonzero(other & (wild | (d <= bar + 1e-9 * size)))
        far = np.sqrt(((x[c] - v[r]) ** 2).sum(1))
    r, ids, far = r[np.isfinite(far)], own[c[np.isfinite(far)]], far[np.isfinite(far)]
    order = np.lexsort((far, ids, r))
    r, ids, far = r[order], ids[order], far[order]
    first = np.append(True, (r[1:] != r[:-1]) | (ids[1:] != ids[:-1]))[: len(r)]
    r, ids, far = r[first], ids[first], far[first]
    order = np.lexsort((ids, far, r))
    r, ids, far = r[order], ids[order], far[order]
    kept = np.arange(len(r)) - np.searchsorted(r, r) < k
    return q[r[kept]], ids[kept], far[kept]


def valid(vectors: DataFrame, is_query: Column, id_col: str, vector_col: str) -> DataFrame:
    """id, v and asks (it is a query): the rows that take part; v in single precision only where the table has no more."""
    v = F.col(vector_col)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    kind = "array<float>" if vectors.select(v).dtypes[0][1] == "array<float>" else "array<double>"
    rows = vectors.where(v.isNotNull() & F.col(id_col).isNotNull() & sound).select(F.col(id_col).cast("long").alias("id"), v.cast(kind).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (usual["n"] if usual else 0))


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def search(
    vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, list_rows: int = 100, max_sample: int = 40_000,
    replica_slack: float = 0.25, max_replicas: int = 6, recall: float = 0.93, min_lists: int = 8, chunk_rows: int = 4_000,
) -> DataFrame:
    """query_id, rank, vec_id, score for each row of vectors that is_query names. max_sample bounds the rows the index is fitted on; all rows are indexed."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "posting-lists")
    rows = scratch.put(valid(vectors, is_query, id_col, vector_col))
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < (1 << 20) * max_sample / n).orderBy("id").limit(max_sample).toPandas()
    x = _stack(sample["v"]).astype(np.float32) if len(sample) else np.zeros((1, 1), np.float32)
    lists = max(1, min(n // list_rows, len(x) // 8))
    points = balanced_kmeans(x, lists)
    ratio = needed_ratio(x, Centroids(points), k, recall, replica_slack, max_replicas)

    def routed(query: bool):
        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = Centroids(points)
            few = max(16, min(1024, CELLS // len(points)))
            for whole in batches:
                for at in range(0, len(whole), few):
                    pdf = whole.iloc[at : at + few]
                    v = _stack(pdf["v"]).astype(np.float32)
                    if query:
                        ids, far = known.search(v, len(points), ratio)
                        take = np.isfinite(far) & ((far <= ratio * far[:, :1] + 1e-12) | (np.arange(ids.shape[1]) < min_lists))
                    else:
                        ids, take = held_in(known, v, replica_slack, max_replicas)
                    r, c = np.nonzero(take)
                    to, own, held = ids[r, c].astype(np.int32), pdf["id"].to_numpy(), pdf["v"].to_numpy()
                    for k in range(0, len(r), FRAME):
                        part = slice(k, k + FRAME)
                        yield pd.DataFrame({"list": to[part], "id": own[r[part]], "v": held[r[part]]})

        return each

    schema = f"list int, id long, v {dict(rows.dtypes)['v']}"
    postings = scratch.put(rows.mapInPandas(routed(False), schema))
    sizes = postings.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / chunk_rows).cast("int").alias("chunks"))
    sizes = F.broadcast(sizes)  # at most max_sample / 8 rows
    postings = postings.join(sizes, "list").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    asked = rows.where("asks").mapInPandas(routed(True), schema).join(sizes, "list")
    asked = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))

    def compare(held: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(held) and len(asks):
            x, own, q, v = _stack(held["v"]), held["id"].to_numpy(), asks["id"].to_numpy(), _stack(asks["v"])
            few = max(1, PAIRS // len(x))
            found += [nearest(x, own, v[at : at + few], q[at : at + few], k) for at in range(0, len(q), few)]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    key = ["list", "chunk"]
    found = postings.select(*key, "id", "v").groupBy(*key).cogroup(asked.select(*key, "id", "v").groupBy(*key)).applyInPandas(compare, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id")))
    return best.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
