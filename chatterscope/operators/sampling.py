"""Sampling, evaluation and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def seeded(seed: int, *key: str) -> Column:
    """A place in a fixed shuffle: the digest of seed and key, the same in every engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))


def simple_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    return rows.orderBy(seeded(seed, key), key).limit(n)


def round_robin(rows: DataFrame, strata: list[str], key: str, n: int, seed: int) -> DataFrame:
    """n rows, one of each stratum in turn; ``turn`` and ``place`` tell the order. Only the first n of a stratum can be taken."""
    w = W.partitionBy(*strata).orderBy(seeded(seed, key), key)
    turned = rows.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= n)
    return turned.orderBy("turn", *strata).limit(n)


def allocate(sizes: dict, n: int) -> dict:
    """Proportional quotas of at least one a stratum: cut from the largest, topped up by the largest remainders."""
    total = sum(sizes.values())
    if total <= n:
        return dict(sizes)
    keys = sorted(sizes)
    out = {k: min(sizes[k], max(1, n * sizes[k] // total)) for k in keys}
    while sum(out.values()) > n:
        largest = max(out.values())
        out[next(k for k in keys if out[k] == largest)] -= 1
    order = sorted(keys, key=lambda k: (-(n * sizes[k] % total), k))
    while sum(out.values()) < n:
        for k in order:
            if sum(out.values()) < n and out[k] < sizes[k]:
                out[k] += 1
    return out


def stratified(rows: DataFrame, stratum: str, key: str, n: int, seed: int) -> DataFrame:
    """Quotas from the strata's counts, then the first of each in seeded order."""
    sizes = {r[stratum]: r["count"] for r in rows.groupBy(stratum).count().collect()}  # one row a stratum
    quota = F.create_map(*[x for k, v in allocate(sizes, n).items() for x in (F.lit(k), F.lit(v))])
    w = W.partitionBy(stratum).orderBy(seeded(seed, key), key)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).where(F.col("_r") <= quota[F.col(stratum)]).drop("_r")


def confusion(rows: DataFrame, gold: str, model: str) -> DataFrame:
    return rows.groupBy(gold, model).agg(F.count(F.lit(1)).alias("n"))


def scores(rows: DataFrame, gold: str, model: str) -> DataFrame:
    """Per class n, precision, recall and F1, halves to even at 4 digits; classes without gold rows are left out."""
    each = rows.select(F.explode(F.array(F.struct(F.col(gold).alias("label"), F.lit(1).alias("g"), F.lit(0).alias("m"), (F.col(gold) == F.col(model)).cast("int").alias("hit")), F.struct(F.col(model).alias("label"), F.lit(0).alias("g"), F.lit(1).alias("m"), F.lit(0).alias("hit")))).alias("e")).select("e.*")
    t = each.where("label is not null").groupBy("label").agg(F.sum("g").alias("gold_n"), F.sum("m").alias("model_n"), F.sum("hit").alias("hits")).where("gold_n > 0")
    p, r = F.try_divide(F.col("hits").cast("double"), "model_n"), F.try_divide(F.col("hits").cast("double"), "gold_n")
    f1 = F.coalesce(F.try_divide(2 * F.coalesce(p, F.lit(0.0)) * r, F.coalesce(p, F.lit(0.0)) + r), F.lit(0.0))
    return t.select("label", "gold_n", F.bround(p, 4).alias("precision"), F.bround(r, 4).alias("recall"), F.bround(f1, 4).alias("f1"))


def agreement(a: DataFrame, b: DataFrame, key: str, label: str) -> DataFrame:
    """Share of common keys with equal labels, over the keys that both label."""
    both = a.select(key, F.col(label).alias("_a")).join(b.select(key, F.col(label).alias("_b")), key).where("_a is not null and _b is not null")
    return both.agg(F.count(F.lit(1)).alias("n"), F.bround(F.avg((F.col("_a") == F.col("_b")).cast("double")), 4).alias("rate"))


def pack_batches(rows: DataFrame, key: str, order: str, text: str, size: int, tokens: int, most_bytes: int) -> DataFrame:
    """key, order, batch: greedy batches per key in order under three limits; rows that exceed one alone get batch -1."""
    import math

    import pandas as pd

    kinds = dict(rows.dtypes)

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        batch, held, used, bytes_, out = 0, 0, 0.0, 0, []
        for t in pdf[text].fillna(""):
            wide = sum(ord(c) > 127 for c in t)
            cost, length = 1.6 * wide + 0.34 * (len(t) - wide), len(t.encode())
            if held and (held + 1 > size or math.ceil((used + cost) * 1.15) > tokens or bytes_ + length > most_bytes):
                batch, held, used, bytes_ = batch + 1, 0, 0.0, 0
            if math.ceil(cost * 1.15) > tokens or length > most_bytes:
                out.append(-1)
                continue
            held, used, bytes_ = held + 1, used + cost, bytes_ + length
            out.append(batch)
        return pd.DataFrame({key: pdf[key], order: pdf[order], "batch": out})

    return rows.select(key, order, text).groupBy(key).applyInPandas(group, f"{key} {kinds[key]}, {order} {kinds[order]}, batch int")
