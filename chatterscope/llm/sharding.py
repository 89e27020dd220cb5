"""Sharding by a k-d tree with distributed weighted medians.

A node that still has to give k shards is split along its widest metadata dimension at the weighted quantile
floor(k/2)/k of its bytes; leaves are the shards. The dimensions are length, bytes a character
(the script) and characters a line. A dimension's key is its value (20 bits) above a 32-bit hash of the text, so equal texts are neighbours in every dimension and a cut divides them only where one group of
copies is itself larger than the tolerance; then doc_id's hash divides it. Quantiles come from histograms of at
most ``BINS`` bins a node, refined around the cut until the bin at the cut weighs less than the tolerance: what
reaches the driver is bounded by nodes x BINS, whatever the input's size.

Defined cases: a null text has no bytes and the empty text's hash; ties and
repeated rows are divided by hash of the id, whole rows if the ids are equal; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterscope.llm.common import Scratch, dense_index

BINS = 1024
TOP = 1 << 20
#: So many copies of one text are never divided: a hash of the id would divide them by chance only.
FEW = 16


def metadata(docs: DataFrame) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    size = F.octet_length(t).cast("long") + 8
    lines = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1
    rows = docs.select("doc_id", size.alias("size"), F.crc32(F.encode(t, "UTF-8")).alias("text_crc32"), F.xxhash64(t).alias("_th"), F.length(t).alias("_n"), lines.alias("_lines"))
    low = F.shiftrightunsigned("_th", 32).bitwiseAND(0xFFFFFFFF)
    scaled = lambda v, most: F.least(F.lit(TOP - 1), F.floor(v * F.lit(TOP / most))).cast("long")
    key = lambda v: (v * F.lit(1 << 32) + low).cast("long")
    size_, n = F.col("size").cast("double"), F.col("_n").cast("double")
    return rows.select(
        "doc_id", "size", "text_crc32", F.pmod(F.xxhash64("doc_id", "_th"), F.lit(TOP)).cast("long").alias("_u"),
        key(scaled(F.log2(size_), 32.0)).alias("_d0"),
        key(scaled((size_ - 8) / F.greatest(n, F.lit(1.0)) - 1, 3.001)).alias("_d1"),
        key(scaled(F.log2(1 + n / F.col("_lines")), 32.0)).alias("_d2"),
    )


def split_tree(meta: DataFrame, n_shards: int, tolerance: float, dims: list[str]) -> Column:
    """The expression that gives each row of meta its shard; every level costs a few scans of meta."""
    split: dict[int, tuple] = {}  # node -> (dimension, cut, share of the cut's own key that goes left, left, right)
    parts = {1: n_shards}
    fresh = 2

    def place(node: int) -> Column:
        if node not in split:
            return F.lit(node)
        dim, cut, share, left, right = split[node]
        goes = (F.col(dim) < F.lit(cut)) | ((F.col(dim) == F.lit(cut)) & (F.pmod(F.xxhash64("_u", F.lit(node)), F.lit(TOP)) < F.lit(share)))
        return F.when(goes, place(left)).otherwise(place(right))

    while any(k > 1 for k in parts.values()):
        at = meta.withColumn("_node", place(1))
        open_ = [n for n, k in parts.items() if k > 1]
        stats = {r["_node"]: r for r in at.where(F.col("_node").isin(open_)).groupBy("_node").agg(F.sum("size").alias("w"), *[f(d).alias(f"{x}{d}") for d in dims for x, f in (("a", F.min), ("b", F.max))]).collect()}
        want, box, dim, before = {}, {}, {}, {}
        for n in open_:
            k = parts.pop(n)
            halves = {fresh: k // 2, fresh + 1: k - k // 2}
            parts |= halves
            if n not in stats:  # no rows
                split[n] = (dims[0], 0, 0, fresh, fresh + 1)
            else:
                r = stats[n]
                dim[n] = max(dims, key=lambda d: (r[f"b{d}"] - r[f"a{d}"], d))
                want[n], box[n], before[n] = r["w"] * (k // 2) / k, (r[f"a{dim[n]}"], r[f"b{dim[n]}"] + 1), 0
                split_to = (fresh, fresh + 1)
                split[n] = None
                want[n] = (want[n], split_to, r["w"])
            fresh += 2
        while box:
            node = F.col("_node")
            low = F.coalesce(*[F.when(node == n, F.lit(b[0])) for n, b in box.items()])
            wide = F.coalesce(*[F.when(node == n, F.lit(max(1, -(-(b[1] - b[0]) // BINS)))) for n, b in box.items()])
            value = F.coalesce(*[F.when(node == n, F.col(dim[n])) for n in box])
            inside = F.coalesce(*[F.when(node == n, (F.col(dim[n]) >= F.lit(b[0])) & (F.col(dim[n]) < F.lit(b[1]))) for n, b in box.items()], F.lit(False))
            bins: dict[int, dict[int, int]] = {n: {} for n in box}
            members: dict[tuple[int, int], int] = {}
            for r in at.where(inside).groupBy("_node", ((value - low - F.pmod(value - low, wide)) / wide).cast("long").alias("bin")).agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n")).collect():
                bins[r["_node"]][r["bin"]], members[r["_node"], r["bin"]] = r["w"], r["n"]
            for n in list(box):
                target, (left, right), total = want[n]
                a, b = box[n]
                step = max(1, -(-(b - a) // BINS))
                acc, hit = before[n], None
                for i in sorted(bins[n]):
                    if acc + bins[n][i] >= target:
                        hit = i
                        break
                    acc += bins[n][i]
                if hit is None:  # rounding: all goes left
                    split[n] = (dim[n], b, 0, left, right)
                elif step == 1:  # one key: copies of a text, divided only if they weigh more than the tolerance
                    w = bins[n][hit]
                    near = target - acc
                    if w <= tolerance * total or members[n, hit] <= FEW:
                        share = TOP if near * 2 >= w else 0
                    else:
                        share = round(TOP * near / w)
                    split[n] = (dim[n], a + hit, share, left, right)
                elif bins[n][hit] <= tolerance * total:
                    cut = a + (hit + 1) * step if 2 * (target - acc) >= bins[n][hit] else a + hit * step
                    split[n] = (dim[n], cut, 0, left, right)
                else:
                    box[n], before[n] = (a + hit * step, min(b, a + (hit + 1) * step)), acc
                    continue
                del box[n]
    leaves = sorted(parts)

    def final(node: int) -> Column:
        if node not in split:
            return F.lit(leaves.index(node))
        dim_, cut, share, left, right = split[node]
        goes = (F.col(dim_) < F.lit(cut)) | ((F.col(dim_) == F.lit(cut)) & (F.pmod(F.xxhash64("_u", F.lit(node)), F.lit(TOP)) < F.lit(share)))
        return F.when(goes, final(left)).otherwise(final(right))

    return final(1)


def shard(docs: DataFrame, n_shards: int | None = 24, target_bytes: int | None = None, tolerance: float = 0.0005) -> DataFrame:
    """doc_id, size, text_crc32, shard (0..), slot (0.. without gaps in the shard). Law: sizes near equal.

    Give n_shards, or target_bytes for as many leaves as keep each near that size.
    """
    scratch = Scratch(docs.sparkSession, "sharding")
    meta = scratch.put(metadata(docs))
    total = meta.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("w")).first()
    if target_bytes is not None:
        n_shards = max(1, -(-(total["w"] or 0) // target_bytes))
    placed = meta.withColumn("shard", split_tree(meta, n_shards, tolerance, ["_d0", "_d1", "_d2"]).cast("int"))
    out = dense_index(placed, ["shard"], ["text_crc32", "doc_id", "_u"], total["n"], "slot")
    return out.select("doc_id", "size", "text_crc32", "shard", "slot")
