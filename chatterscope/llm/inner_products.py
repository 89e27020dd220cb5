"""Exact k largest inner products over vectors sorted by length.

Components become floor(scale * x), so scores are integers. Vectors are dealt to buckets of descending length, and a
query's score with any vector is at most the product of both lengths (Cauchy-Schwarz). The longest vectors of all, a
bounded number, give each query a first k-th score; it visits only buckets long enough to reach it. In a bucket,
vectors come in blocks, longest first. Both sides are turned onto the singular vectors of all rows, which puts most of an
inner product into the first dimensions: the sum over those, and the product of what is left of both lengths, bounds
the score, and only pairs whose bound reaches the query's k-th score so far are summed in full, in integers.

The bounds are in double precision and loosened by more than its rounding; a pair that is cut could not have been
among the k, ties included. Nothing is approximate and nothing is capped.

Queries are dealt to a bucket in shares of at most ``QUERIES``, with the bucket's vectors beside each share, so no task
holds more than a bucket and a share.

Defined cases: vectors that are null, of another length than most, or hold null or non-finite components take no part,
nor do rows without an id, nor vectors whose integer length is 2**31 or more, whose scores may exceed a long; ties go to
the smaller id; rows of one id are one candidate with its best score, and never their own; with fewer than k candidates all
are given; no valid rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chatterscope.llm.common import Scratch, ranged

#: Queries of a share, vectors of a bucket, vectors of a block within it, longest vectors for the first bounds, and lengths that tell which buckets a query visits.
QUERIES, BUCKET, BLOCK, FIRST, STEPS = 32_768, 16_384, 2_048, 2_048, 4_096
RESULT = "query_id long, rank int, vec_id long, score long"


def valid(vectors: DataFrame, is_query: Column, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """id, v (integers), norm (length) and asks (it is a query) of the rows that take part."""
    v = F.col(vector_col)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    rows = vectors.where(v.isNotNull() & F.col(id_col).isNotNull() & sound).select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), whole.alias("v"))
    rows = rows.groupBy("id", "v").agg(F.max("asks").alias("asks"))  # equal rows are one, however many
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))
    rows = rows.where(F.col("norm") < float(1 << 31))
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (usual["n"] if usual else 0))


def stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64)


def singular_vectors(rows: DataFrame) -> np.ndarray:
    """The right singular vectors of all rows, by descending singular value: from the sum of outer products, one matrix a partition."""

    def outer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            if len(pdf):
                x = stacked(pdf["v"]).astype(np.float64)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pd.DataFrame({"m": [total.tobytes()]})

    add = lambda a, b: (np.frombuffer(a) + np.frombuffer(b)).tobytes()
    gram = np.frombuffer(rows.select("v").mapInPandas(outer, "m binary").rdd.map(lambda r: bytes(r["m"])).treeReduce(add))
    d = int(round(len(gram) ** 0.5))
    return np.linalg.eigh(gram.reshape(d, d))[1][:, ::-1].copy()


class Best:
    """The k best of each query so far: scores descending, ties by id; one entry an id."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor.astype(np.float64)
        self.scores, self.ids = [np.empty(0, np.int64) for _ in range(n)], [np.empty(0, np.int64) for _ in range(n)]

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.scores[q], scores]), np.concatenate([self.ids[q], ids])
        order = np.lexsort((i, -s))
        s, i = s[order], i[order]
        if len(np.unique(i)) < len(i):
            first = np.sort(np.unique(i, return_index=True)[1])
            s, i = s[first], i[first]
        self.scores[q], self.ids[q] = s[: self.k], i[: self.k]
        if len(i) >= self.k:
            self.floor[q] = max(self.floor[q], s[self.k - 1])


def exact(x: np.ndarray, y: np.ndarray, most: float) -> np.ndarray:
    """x @ y.T in integers; ``most`` bounds any partial sum, and below 2**53 doubles are exact."""
    if most < float(1 << 53):
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    return x @ y.T


def compare_block(q: np.ndarray, q_turned: np.ndarray, x: np.ndarray, turned: np.ndarray, floor: np.ndarray, cuts: tuple[int, ...]) -> np.ndarray:
    """Which pairs of a query and a vector may reach the query's floor: bounds over more and more dimensions."""
    lengths = lambda a: np.sqrt((a * a).sum(axis=1))
    slack = 1e-9 * (1 + lengths(q_turned)[:, None] * lengths(turned)[None])
    live = lengths(q_turned)[:, None] * lengths(turned)[None] + slack >= floor[:, None]
    partial, at = np.zeros(live.shape), 0
    for cut in cuts:
        if not live.any():
            break
        partial += q_turned[:, at:cut] @ turned[:, at:cut].T
        at = cut
        live &= partial + lengths(q_turned[:, cut:])[:, None] * lengths(turned[:, cut:])[None] + slack >= floor[:, None]
    return live


def search_bucket(held: pd.DataFrame, asks: pd.DataFrame, basis: np.ndarray, k: int, counter: list[int] | None = None) -> pd.DataFrame:
    """query_id, vec_id, score: the k best of this bucket's vectors for each query, as far as they reach its floor. counter: pairs, and pairs summed in full."""
    if not len(held) or not len(asks):
        return pd.DataFrame({c: np.empty(0, np.int64) for c in ("query_id", "vec_id", "score")})
    held = held.sort_values(["norm", "id"], ascending=[False, True], kind="stable")
    x, ids = stacked(held["v"]), held["id"].to_numpy(np.int64)
    q, own = stacked(asks["v"]), asks["id"].to_numpy(np.int64)
    turned, q_turned = x @ basis, q @ basis
    d = x.shape[1]
    energy = np.cumsum((turned * turned).sum(axis=0)) / max(1.0, float((turned * turned).sum()))
    cuts = tuple(sorted({int(np.searchsorted(energy, share)) + 1 for share in (0.6, 0.85)} - {d, d + 1}))
    most = float(held["norm"].max()) * float(asks["norm"].max()) * 1.001
    best = Best(len(q), k, asks["floor"].to_numpy(np.float64))
    for start in range(0, len(q), 1024):
        some = np.arange(start, min(start + 1024, len(q)))
        for at in range(0, len(x), BLOCK):
            block = slice(at, at + BLOCK)
            live = compare_block(q[some], q_turned[some], x[block], turned[block], best.floor[some], cuts) & (own[some][:, None] != ids[block][None])
            if counter is not None:
                counter[0] += live.size
                counter[1] += int(live.sum())
            if live.mean() > 0.2:
                scores = exact(q[some], x[block], most)
            else:
                r, c = np.nonzero(live)
                scores = np.zeros(live.shape, np.int64)
                for i in range(0, len(r), 65_536):
                    scores[r[i : i + 65_536], c[i : i + 65_536]] = (q[some[r[i : i + 65_536]]] * x[block][c[i : i + 65_536]]).sum(axis=1)
            for j in np.flatnonzero(live.any(axis=1)):
                hits = np.flatnonzero(live[j] & (scores[j] >= best.floor[some[j]]))
                if len(hits) > 4 * k:  # ties at the k-th stay
                    hits = hits[scores[j, hits] >= np.partition(scores[j, hits], len(hits) - k)[len(hits) - k]] if len(np.unique(ids[block][hits])) == len(hits) else hits
                if len(hits):
                    best.add(some[j], scores[j, hits], ids[block][hits])
    n = [len(i) for i in best.ids]
    return pd.DataFrame({"query_id": np.repeat(own, n), "vec_id": np.concatenate(best.ids), "score": np.concatenate(best.scores)})


def first_floors(rows: DataFrame, k: int) -> DataFrame:
    """The queries, each with a score that its k-th best reaches: its k-th among the longest vectors, below all scores where they are fewer."""
    longest = rows.orderBy(F.desc("norm"), "id").limit(FIRST).select("id", "v", "norm").toPandas()  # FIRST rows, whatever the input
    ids, x = longest["id"].to_numpy(np.int64), stacked(longest["v"])
    top = float(longest["norm"].max())
    unique = len(np.unique(ids)) == len(ids)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            floors = []
            for at in range(0, len(pdf), 1024):
                some = pdf.iloc[at : at + 1024]
                scores = exact(stacked(some["v"]), x, top * float(some["norm"].max()) * 1.001)
                for own, row in zip(some["id"].tolist(), scores, strict=True):
                    keep = ids != own
                    row, names = row[keep], ids[keep]
                    if not unique:
                        order = np.lexsort((names, -row))
                        row = row[order][np.unique(names[order], return_index=True)[1]]
                    floors.append(float(np.partition(row, len(row) - k)[len(row) - k]) if len(row) >= k else -np.inf)
            yield pdf.assign(floor=floors)

    return rows.where("asks").select("id", "v", "norm").mapInPandas(each, "id long, v array<long>, norm double, floor double")


def search(vectors: DataFrame, is_query: Column, scale: float = 1024, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, bucket_rows: int = BUCKET) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each row that is_query names with all rows of another id."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "inner-products")
    rows = scratch.put(valid(vectors, is_query, scale, id_col, vector_col))
    n = rows.count()
    if not n:
        return spark.createDataFrame([], RESULT)
    basis = singular_vectors(rows)
    # equal lengths are divided by a hash, so that a bucket's size does not depend on ties
    order = [F.desc("norm"), F.xxhash64("id", "v")]
    buckets = scratch.put(ranged(rows, max(1, -(-n // bucket_rows)), order).withColumnRenamed("part", "bucket"))
    queries = scratch.put(first_floors(rows, k))
    shares = max(1, -(-queries.count() // QUERIES))
    # buckets descend, so the first numbers are those a query visits; steps of several buckets keep the table of lengths small
    step = -(-(buckets.agg(F.max("bucket")).first()[0] + 1) // STEPS)
    longest = buckets.groupBy(F.floor(F.col("bucket") / step).alias("step")).agg(F.max("norm").alias("longest")).orderBy("step").collect()
    tops, ends = np.array([r["longest"] for r in longest]), np.array([0] + [step * (r["step"] + 1) for r in longest])

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            floor = pdf["floor"].to_numpy()
            need = floor / np.maximum(pdf["norm"].to_numpy(), 1e-300) * (1 - 1e-9)
            yield pdf.assign(upto=ends[np.where(floor <= 0, len(tops), np.searchsorted(-tops, -need, side="right"))])

    asked = queries.mapInPandas(visits, "id long, v array<long>, norm double, floor double, upto long").where("upto > 0")
    asked = asked.withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("upto") - 1))).withColumn("share", F.pmod(F.xxhash64("id", "v"), F.lit(shares)))
    held = buckets.select("bucket", "id", "v", "norm").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))))
    key = ["bucket", "share"]

    def compare(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        return search_bucket(x, q, basis, k)

    found = held.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(compare, "query_id long, vec_id long, score long")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
