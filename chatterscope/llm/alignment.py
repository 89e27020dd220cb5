"""Alignment of two tokenizers' tokens over every whole text, and how often pairs of their tokens end together.

Both token lists tile the bytes of a space and the text. The second list's tokens are a static interval index: two
sorted arrays of starts and ends. Each token of the first list stabs it by bisection and gets the range of tokens it
overlaps. A gap between tokens that no overlap spans, where the last token overlapped ends with the one that
asked, is a boundary: gaps cut both lists into groups, and the two tokens that end there are linked.

How many links a pair of ids has in all texts is counted from each document's distinct pairs, so counts are summed before
they are shuffled. The most frequent pairs, at most ``WIDE``, come back as a bounded table in every task; all others
by a join, where no pair is held by many documents.

Defined cases: a text that is null or empty, or whose tokens do not give back the space and the text (some
characters are normalised by the second tokenizer), has no tokens: zeros, and an empty string for the groups' digest; special
tokens' strings in a text are plain text; repeated rows count each; no rows give no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterscope.llm.common import Scratch

#: Pairs whose counts are broadcast: 4 MB.
WIDE = 1 << 18
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


class Bytes:
    """The byte-level tokenizer: ids of a text, and each id's bytes."""

    def __init__(self, ranks_path: str):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            self.bytes[i] = b

    def ids(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)


class Pieces:
    """The piece tokenizer, which puts a space before the text itself."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.bytes = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())

    def ids(self, text: str) -> list[int]:
        return self.model.encode(text)


class Intervals:
    """Tokens that tile a text, as an index of the byte ranges they hold."""

    def __init__(self, lengths: np.ndarray):
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths

    def stab(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first token that each range overlaps, and the one after the last."""
        return np.searchsorted(self.ends, starts, side="right"), np.searchsorted(self.starts, ends, side="left")


def boundaries(a_lengths: np.ndarray, b_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of either list that end where no overlap spans the gap behind them."""
    index = Intervals(b_lengths)
    ends = np.cumsum(a_lengths)
    _, after = index.stab(ends - a_lengths, ends)
    last = after - 1
    unspanned = index.ends[last] == ends
    return np.flatnonzero(unspanned), last[unspanned]


class Names:
    """Decimal ids with each mark behind them, as bytes to be joined."""

    def __init__(self, n: int):
        self.marked = {m: np.array([f"{i}{m}".encode() for i in range(n)], dtype=object) for m in ",|;"}

    def put(self, out: np.ndarray, at: np.ndarray, ids: np.ndarray, last: np.ndarray, mark: str) -> None:
        out[at] = self.marked[","][ids]
        out[at[last]] = self.marked[mark][ids[last]]


def groups_text(a: np.ndarray, b: np.ndarray, a_last: np.ndarray, b_last: np.ndarray, names: Names) -> bytes:
    """``a1,a2|b1;a3|b2,b3``: each group's ids of either list."""
    a_group = np.searchsorted(a_last, np.arange(len(a)), side="left")
    b_group = np.searchsorted(b_last, np.arange(len(b)), side="left")
    # a token stands behind the groups before its own, whole, and behind the first list's part of its own
    a_at = np.arange(len(a)) + np.concatenate([[0], b_last + 1])[a_group]
    b_at = np.arange(len(b)) + (a_last + 1)[b_group]
    out = np.empty(len(a) + len(b), dtype=object)
    names.put(out, a_at, a, a_last, "|")
    names.put(out, b_at, b, b_last, ";")
    return b"".join(out.tolist())[:-1]


def align(docs: DataFrame, ranks_path: str | None = None, model_path: str | None = None) -> DataFrame:
    """One row for each of docs: its counts, the digest of its groups, and its distinct pairs (first id * 2**32 + second) with their links."""
    import public_tokenizers

    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    model_path = model_path or public_tokenizers.path("piece_bpe_32k.model")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, second = Bytes(ranks_path), Pieces(model_path)
        names = Names(max(len(first.bytes), len(second.bytes)))
        a_size, b_size = (np.array([len(x) for x in t.bytes], np.int64) for t in (first, second))
        nothing = (0, 0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int32))

        def aligned(text: str | None) -> tuple:
            if not text:
                return nothing
            want = (" " + text).encode()
            a, b = first.ids(" " + text), second.ids(text)
            if b"".join([second.bytes[i] for i in b]) != want or b"".join([first.bytes[i] for i in a]) != want:
                return nothing
            a, b = np.array(a, np.int64), np.array(b, np.int64)
            a_last, b_last = boundaries(a_size[a], b_size[b])
            digest = hashlib.sha256(groups_text(a, b, a_last, b_last, names)).hexdigest()
            pairs, times = np.unique(a[a_last] << 32 | b[b_last], return_counts=True)
            return len(a), len(b), len(a_last), len(a_last), digest, pairs, times.astype(np.int32)

        for pdf in batches:
            for at in range(0, len(pdf), 512):
                some = pdf.iloc[at : at + 512]
                rows = [aligned(t) for t in some["text"]]
                out = dict(zip(("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"), map(list, zip(*rows, strict=True)), strict=True))
                yield pd.DataFrame({"doc_id": some["doc_id"].to_numpy(), **out})

    named = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    schema = ALIGNED.replace("doc_id long", "doc_id string")
    return named.mapInPandas(each, schema).withColumn("doc_id", F.col("doc_id").cast("long"))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, links (in all texts), best (no pair of its second id has more)."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    counts = each.groupBy("pair").agg(F.sum("times").alias("links"))
    return counts


def digest(aligned: DataFrame, wide: int = WIDE) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of ``align``."""
    scratch = Scratch(aligned.sparkSession, "alignment")
    aligned = scratch.put(aligned.withColumn("row", F.monotonically_increasing_id()), compression="zstd")
    counts = scratch.put(pair_counts(aligned))
    second = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("second")
    most = counts.groupBy(second).agg(F.max("links").alias("most"))  # at most one row an id of the second vocabulary
    counts = scratch.put(counts.join(most, second == F.col("second")).select("pair", "links", (F.col("links") == F.col("most")).alias("best")))
    top = counts.orderBy(F.desc("links"), "pair").limit(wide).toPandas().sort_values("pair")
    keys, links, best = top["pair"].to_numpy(np.int64), top["links"].to_numpy(np.int64), top["best"].to_numpy(bool)
    table = aligned.sparkSession.sparkContext.broadcast((keys, links, best))

    def known(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, links, best = table.value
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                some = pdf.iloc[at : at + 512]
                sizes = np.array([len(x) for x in some["pairs"]])
                pairs = np.concatenate([*some["pairs"], np.empty(0, np.int64)]).astype(np.int64)
                times = np.concatenate([*some["times"], np.empty(0, np.int32)]).astype(np.int64)
                i = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
                found = keys[i] == pairs if len(keys) else np.zeros(len(pairs), bool)
                weights = np.where(found, links[i] * times, 0) if len(keys) else np.zeros(len(pairs), np.int64)
                hits = np.where(found & best[i], times, 0) if len(keys) else np.zeros(len(pairs), np.int64)
                ends = np.cumsum(sizes)
                upto = lambda x: np.concatenate([[0], np.cumsum(x)])
                w, h = upto(weights), upto(hits)
                starts = ends - sizes
                rest = [~found[s:e] for s, e in zip(starts, ends, strict=True)]
                yield pd.DataFrame({
                    "row": some["row"].to_numpy(), "n_best": h[ends] - h[starts], "count_sum": w[ends] - w[starts],
                    "pairs": [pairs[s:e][r] for s, e, r in zip(starts, ends, rest, strict=True)], "times": [times[s:e][r] for s, e, r in zip(starts, ends, rest, strict=True)],
                })

    sums = scratch.put(aligned.select("row", "pairs", "times").mapInPandas(known, "row long, n_best long, count_sum long, pairs array<long>, times array<long>"), compression="zstd")
    rare = sums.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    rare = rare.join(counts, "pair").select("row", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("links") * F.col("times")).alias("count_sum"))
    all_ = sums.select("row", "n_best", "count_sum").unionByName(rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    own = aligned.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return own.join(all_, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
