"""Language-model scoring by a probabilistic suffix tree.

Symbols are the training words and one end a text; contexts are the symbols before. A context, and a symbol after it, is
a candidate from ``least`` occurrences on, whatever the corpus: what is learnt grows with it. A context is retained
if its next symbols diverge from those of its longest retained suffix by more than ``penalty`` nats for each symbol seen
after it. Only retained contexts are deepened: one symbol a level, until none is retained or they have ``longest`` symbols
(runs of one word would deepen for as long as they are). Distributions are
smoothed with the suffix's by the number of distinct symbols. A token is scored in the state of the longest retained
suffix of what stands before it. The root gives known words their counts and unknown ones the share of words seen once.

A text's log score is a sum over its words and grams: each retained context adds the logarithm of what it leaves to its
suffix, each of its symbols the rest of its own. So the model is one table of weights by the 64-bit hash of the gram.
Texts are written once as chunks of numbered words. A chunk asks for the grams it has, each once however often it stands
there, packed by leading bits of the hash; the tasks that hold these weights answer, and the chunk sums them for its
texts. So the model is never in one place, nor are the occurrences of a frequent gram: one costs eight bytes a chunk. What is
broadcast is bounded: the ``head`` most frequent words, and bit maps of at most ``SIEVE_BITS`` that leave out
most grams that have no weight; what passes them by chance finds nothing.

Defined cases: a null text is empty and scores its end alone; a null id is the text ``null`` for the split; repeated
rows are counted and scored each; without training tokens both scores are null; further columns are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterscope.llm.common import Scratch, passes, sieve

END = b""  #: no word is empty
CHUNK = 600_000  #: tokens that are looked at together
NUMBERS = 3_000_000  #: that a task holds before it tells


def words(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def is_training(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null"))) % 10 != 0


def _hash(word: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


def mixed(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    x = b.view(np.uint64) ^ np.uint64(salt * 0x632BE59BD9B4E019 % 2**64)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x += a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(by)
    return x.view(np.int64)


class Lexicon(dict):
    """Words numbered as they come, with their hashes."""

    def __init__(self) -> None:
        self.hashes = array("q")

    def __missing__(self, word: bytes) -> int:
        self[word] = i = len(self.hashes)
        self.hashes.append(_hash(word))
        return i


def _ints(column: object, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(column, kind)


def chunked(docs: DataFrame) -> DataFrame:
    """chunk, doc_id (as texts, so that nulls among them change none), train, lengths, words (hashes), ids: texts as word numbers, each after and before an end."""

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 33
        held: list[tuple[object, bool, int]] = []
        lexicon, ids = Lexicon(), array("i")

        def told() -> pd.DataFrame:
            return pd.DataFrame({
                "chunk": [number], "doc_id": [[h[0] for h in held]], "train": [np.array([h[1] for h in held], bool).tobytes()], "lengths": [np.array([h[2] for h in held], np.int64).tobytes()],
                "words": [lexicon.hashes.tobytes()], "ids": [pa.compress(ids.tobytes(), "zstd", asbytes=True)],
            })

        for pdf in parts:
            for doc, train, text in zip(pdf["doc_id"], pdf["train"], pdf["text"], strict=True):
                before = len(ids)
                ids.append(lexicon[END])
                ids.extend(map(lexicon.__getitem__, words(text)))
                ids.append(lexicon[END])
                held.append((doc, bool(train), len(ids) - before))
                if len(ids) > CHUNK:
                    yield told()
                    number, held, lexicon, ids = number + 1, [], Lexicon(), array("i")
        if held:
            yield told()

    return docs.mapInPandas(each, "chunk long, doc_id array<string>, train binary, lengths binary, words binary, ids binary")


class Chunk:
    """A chunk's tokens. ``grams[k]`` names the k + 1 symbols that end at a place; it means nothing where ``at`` is under k."""

    def __init__(self, row: object, depth: int):
        self.lengths = _ints(row.lengths)
        self.doc = np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths)
        self.at = np.arange(len(self.doc), dtype=np.int32) - np.repeat((np.cumsum(self.lengths) - self.lengths).astype(np.int32), self.lengths)  # place in the text
        self.train = _ints(row.train, bool)[self.doc]
        self.hashes, self.ids = _ints(row.words), _ints(pa.decompress(row.ids, 4 * len(self.doc), "zstd", asbytes=True), np.int32)
        self.grams = [self.hashes[self.ids]]
        for k in range(1, depth + 1):
            self.grams.append(mixed(np.roll(self.grams[-1], 1), self.grams[-1], k))


def chunks(parts: Iterator[pd.DataFrame], depth: int) -> Iterator[tuple[object, Chunk]]:
    for pdf in parts:
        for row in pdf.itertuples(index=False):
            yield row, Chunk(row, depth)


def _count_words(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for _, c in chunks(parts, 0):
        n = np.bincount(c.ids[c.train & (c.at > 0)], minlength=len(c.hashes))
        yield pd.DataFrame({"h": c.hashes[n > 0], "n": n[n > 0]})
        del c  # before the next one is made


def joined(held: list[np.ndarray]) -> np.ndarray:
    """The arrays as one; the list is empty then, so that they are not held twice."""
    out = np.concatenate(held)
    held.clear()
    return out


def summed(key: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys (unsigned) in order, each once, a place where each stands and the sum of its n, or how often it is there."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = cut_at(key)
    total = np.diff(np.append(at, len(key))) if n is None else np.add.reduceat(n[order], at) if len(at) else n
    return key[at], order[at], total


def buckets(key: np.ndarray, bits: int) -> np.ndarray:
    return (key.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def cut_at(bucket: np.ndarray) -> np.ndarray:
    """Where a sorted array's runs begin."""
    return np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, int)


def often(store: DataFrame, least: int, bits: int) -> DataFrame:
    """key: of the pairs that may be there ``least`` times, as far as their leading 32 bits behind the bucket's tell."""

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, waiting = [], 0
        for _, c in chunks(parts, 1):
            held.append(c.grams[1][c.train & (c.at > 0)].view(np.uint64))
            waiting += len(held[-1])
            del c
            if waiting > NUMBERS:
                yield packed(held)
                waiting = 0
        if waiting:
            yield packed(held)

    def packed(held: list[np.ndarray]) -> pd.DataFrame:
        key = joined(held)
        key.sort()
        at = cut_at(key)
        key, n = key[at], np.diff(np.append(at, len(key)))
        bucket = (key >> np.uint64(64 - bits)).astype(np.int64)
        low = (key >> np.uint64(32 - bits)).astype(np.uint32)
        at = cut_at(bucket)
        return pd.DataFrame({"bucket": bucket[at], "low": [x.tobytes() for x in np.split(low, at[1:])], "n": [x.tobytes() for x in np.split(np.minimum(n, least).astype(np.uint8 if least < 256 else np.uint32), at[1:])]})

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        low = np.concatenate([_ints(x, np.uint32) for x in pdf["low"]])
        n = np.concatenate([_ints(x, np.uint8 if least < 256 else np.uint32) for x in pdf["n"]]).astype(np.int64)
        low, _, n = summed(low, n)
        key = low[n >= least].astype(np.uint64) << np.uint64(32 - bits)
        return pd.DataFrame({"key": (key | np.uint64(int(pdf["bucket"].iloc[0]) << (64 - bits))).view(np.int64)})

    return store.mapInPandas(each, "bucket long, low binary, n binary").groupBy("bucket").applyInPandas(merged, "key long")


def counted(store: DataFrame, depth: int, fits: Callable[[Chunk], np.ndarray], least: int, bits: int) -> DataFrame:
    """key, ctx, suf, n: the grams of depth + 1 symbols that are in the training texts from ``least`` times on, of the places that fit.

    ctx is the gram without its last symbol, suf without its first. Numbers go to the merging tasks packed by leading bits of the key.
    """

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ctx, suf, waiting = [], [], 0

        def told() -> pd.DataFrame:
            a, b = joined(ctx), joined(suf)
            key, at, n = summed(mixed(a, b, depth).view(np.uint64))
            a, b, bucket = a[at], b[at], buckets(key, bits)
            cuts = cut_at(bucket)
            parts = {k: [x.tobytes() for x in np.split(v, cuts[1:])] for k, v in (("ctx", a), ("suf", b), ("n", n.astype(np.int32)))}
            return pd.DataFrame({"bucket": bucket[cuts], **parts})

        for _, c in chunks(parts, depth):
            i = np.flatnonzero(c.train & (c.at >= depth) & fits(c))
            suf.append(c.grams[depth - 1][i])
            i -= 1
            ctx.append(c.grams[depth - 1][i])
            waiting += len(i)
            del c, i
            if waiting > NUMBERS:
                yield told()
                waiting = 0
        if waiting:
            yield told()

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        ctx, suf, n = (np.concatenate([_ints(x, t) for x in pdf[k]]) for k, t in (("ctx", np.int64), ("suf", np.int64), ("n", np.int32)))
        key, at, n = summed(mixed(ctx, suf, depth).view(np.uint64), n.astype(np.int64))
        often = n >= least
        at = at[often]
        return pd.DataFrame({"key": key[often].view(np.int64), "ctx": ctx[at], "suf": suf[at], "n": n[often]})

    packed = store.mapInPandas(each, "bucket long, ctx binary, suf binary, n binary")
    return packed.groupBy("bucket").applyInPandas(merged, "key long, ctx long, suf long, n long")


def retained(entries: DataFrame, penalty: float) -> DataFrame:
    """ctx, total, extra, uses: the contexts to keep. Entries have ctx, n, all (the context's count) and p (the symbol's chance in the suffix)."""
    part = F.least(F.col("n") / F.col("all"), F.lit(1.0))
    sums = entries.groupBy("ctx").agg(F.max("all").alias("all"), F.count(F.lit(1)).alias("kinds"), F.sum(F.col("n") * F.log(part / F.col("p"))).alias("gain"), F.sum(part).alias("seen"), F.sum("p").alias("low"))
    left, low = F.greatest(1 - F.col("seen"), F.lit(0.0)), F.greatest(1 - F.col("low"), F.lit(1e-12))
    rest = F.when(left > 1e-12, F.col("all") * left * F.log(F.greatest(left, F.lit(1e-12)) / low)).otherwise(0.0)
    kept = sums.where(F.col("gain") + rest > penalty * F.col("kinds"))
    #: What a context's dropped symbols had goes back to its suffix.
    return kept.select("ctx", (F.col("all") + F.col("kinds")).alias("total"), (F.col("kinds") + F.col("all") * left).alias("extra"), F.col("all").alias("uses"))


def grow(store: DataFrame, scratch: Scratch, vocabulary: DataFrame, n: int, known: float, least: int, penalty: float, longest: int, bits: int) -> tuple[DataFrame, DataFrame, int]:
    """(h, back) of the retained words, (key, weight) of all grams with a weight, and the most symbols before the last that one has."""
    share = store.sparkSession.sparkContext.broadcast
    back = (F.log10("extra") - F.log10("total")).alias("weight")
    own = (F.col("n") + F.col("extra") * F.col("p")) / F.col("total")
    more = (F.log10("own") - F.log10("extra") + F.log10("total") - F.log10("p")).alias("weight")
    may = share(sieve(scratch.put(often(store, least, bits))))
    fits: Callable[[Chunk], np.ndarray] = lambda c: passes(may.value, c.grams[1])
    #: The level before: its grams with their counts and chances, and whether their context is retained.
    lower = vocabulary.select(F.col("h").alias("key"), "n", (F.col("n") / F.lit(float(n)) * F.lit(float(known))).alias("p"), F.lit(True).alias("kept"))
    words_back, weights, levels, depth = None, [], [], 0
    while True:
        depth += 1
        grams = scratch.put(counted(store, depth, fits, least, bits))
        suffix = lower.where("kept").select(F.col("key").alias("suf"), "p")
        entries = grams.join(suffix, "suf").join(lower.select(F.col("key").alias("ctx"), F.col("n").alias("all")), "ctx")
        entries = scratch.put(entries.select("key", "ctx", "n", "all", "p"))
        scratch.drop(grams)
        kept = scratch.put(retained(entries, penalty))
        if words_back is None:
            words_back = kept.select(F.col("ctx").alias("h"), back.alias("back"))
        else:
            weights.append(kept.select(F.col("ctx").alias("key"), back))
        told = scratch.put(entries.join(kept, "ctx", "left").withColumn("own", own))
        scratch.drop(entries)
        levels += [kept, told]
        weights.append(told.where("own is not null").select("key", more))
        scratch.release()
        lower = told.select("key", "n", F.coalesce("own", "p").alias("p"), F.col("own").isNotNull().alias("kept"))
        if depth == longest or lower.where("kept").isEmpty():
            break
        both = share(sieve(lower.select("key"))), share(sieve(lower.where("kept").select("key")))

        def fits(c: Chunk, depth: int = depth, both: tuple = both) -> np.ndarray:
            """The gram's context was counted, and its suffix stands in a retained one."""
            return np.roll(passes(both[0].value, c.grams[depth]), 1) & passes(both[1].value, c.grams[depth])

    out = weights[0]
    for w in weights[1:]:
        out = out.unionAll(w)
    words_back, out = scratch.put(words_back), scratch.put(out.groupBy("key").agg(F.sum("weight").alias("weight")))
    scratch.drop(*levels)
    return words_back, out, depth


def turned(key: Column) -> Column:
    """The key's bits, turned by 24 places: what leads now says nothing of what led before."""
    return F.shiftleft(key, 24).bitwiseOR(F.shiftrightunsigned(key, 40))


def sieves(keys: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Two bit maps of the keys, by their leading bits and by those behind them."""
    return sieve(keys.select("key")), sieve(keys.select(turned(F.col("key")).alias("key")))


def passes_both(maps: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    found = passes(maps[0], keys)
    k = keys[found].view(np.uint64)
    found[found] = passes(maps[1], ((k << np.uint64(24)) | (k >> np.uint64(40))).view(np.int64))
    return found


def most_used(rows: DataFrame, by: str, most: int, columns: list[str]) -> list[np.ndarray]:
    """The columns, ordered by the first, of about the ``most`` rows that are largest in ``by``; packed on the way to the driver."""
    n = rows.count()
    cut = rows.agg(F.percentile_approx(by, F.lit(1 - most / n), F.lit(10_000))).first()[0] if n > most else 0

    def packed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame({f"c{i}": [pdf[c].to_numpy().tobytes()] for i, c in enumerate(columns)})

    found = rows.where(F.col(by) > cut).select(*columns).mapInPandas(packed, ", ".join(f"c{i} binary" for i in range(len(columns)))).collect()
    out = [np.frombuffer(b"".join(bytes(r[i]) for r in found), np.int64 if i == 0 else np.float64) for i in range(len(columns))]
    order = np.argsort(out[0])
    return [x[order] for x in out]


def looked_up(have: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Places in have; -1 where it is missing."""
    if not len(have):
        return np.full(len(asked), -1)
    i = np.minimum(np.searchsorted(have, asked), len(have) - 1)
    return np.where(have[i] == asked, i, -1)


class Asked:
    """What a chunk needs of the model: its words outside the head and the grams that may have a weight, each key once, in order.

    ``cuts`` are the buckets' beginnings among the keys. With ``places``, ``at`` names the key of each place that needs one and ``doc`` its text.
    """

    def __init__(self, c: Chunk, head: np.ndarray, sieved: tuple[np.ndarray, np.ndarray], bits: int, places: bool = False):
        self.place, said = looked_up(head, c.hashes)[c.ids], c.at > 0
        self.inside, self.tail = said & (self.place >= 0), said & (self.place < 0)
        keys, docs = [], []
        for k, grams in enumerate(c.grams):
            i = np.flatnonzero((c.at >= k) & passes_both(sieved, grams) if k else self.tail)
            keys.append(grams[i].view(np.uint64))
            if places:
                docs.append(c.doc[i])
        c.grams.clear()  # the most of a chunk; nothing asks for them again
        key = joined(keys)
        if places:
            self.doc = joined(docs)
            keys, self.at = np.unique(key, return_inverse=True)
        else:
            key.sort()
            keys = key[cut_at(key)]
        self.keys = keys.view(np.int64)
        bucket = buckets(self.keys, bits)
        self.cuts = np.append(cut_at(bucket), len(bucket))
        self.buckets = bucket[self.cuts[:-1]]


def _ask(head_of, bits_of, depth: int, bits: int):
    """A chunk's keys, a row a bucket."""

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row, c in chunks(parts, depth):
            a = Asked(c, head_of.value[0], bits_of.value, bits)
            yield pd.DataFrame({"bucket": a.buckets, "chunk": row.chunk, "keys": [a.keys[i:j].tobytes() for i, j in zip(a.cuts[:-1], a.cuts[1:], strict=True)]})
            del c, a

    return each


def _answer(asks: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
    """Which of a chunk's keys are held, which of these are words, the weights of all and the base of words."""
    held = held.sort_values("key")
    have, weight, base, known = (held[k].to_numpy(t) for k, t in (("key", np.int64), ("weight", float), ("base", float), ("known", bool)))
    told = []
    for row in asks.itertuples(index=False):
        i = looked_up(have, _ints(row.keys))
        found = i[i >= 0]
        told.append((row.bucket, row.chunk, np.packbits(i >= 0).tobytes(), np.packbits(known[found]).tobytes(), weight[found].tobytes(), base[found][known[found]].tobytes()))
    return pd.DataFrame(told, columns=["bucket", "chunk", "found", "words", "weights", "bases"])


def _tell(head_of, bits_of, depth: int, bits: int, rest: tuple[float, float]):
    """A chunk's texts with their sums, from the head and from what was answered."""

    def each(store: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        head, base_of, own_of = head_of.value
        out, told = [], {r.bucket: r for r in answers.itertuples(index=False)}
        for row, c in chunks(iter([store]), depth):
            a, docs = Asked(c, head, bits_of.value, bits, places=True), len(c.lengths)
            values = np.zeros((3, len(a.keys)))
            for bucket, lo, hi in zip(a.buckets, a.cuts[:-1], a.cuts[1:], strict=True):
                if r := told.get(bucket):
                    i = lo + np.flatnonzero(np.unpackbits(_ints(r.found, np.uint8), count=hi - lo))
                    values[0, i] = _ints(r.weights, float)
                    i = i[np.unpackbits(_ints(r.words, np.uint8), count=len(i)).astype(bool)]
                    values[1, i], values[2, i] = _ints(r.bases, float), 1
            score, base, known = (np.bincount(a.doc, v[a.at], docs).astype(float) for v in values)  # a chunk may ask for nothing
            for total, x, y in ((score, own_of, rest[0]), (base, base_of, rest[1])):
                total += np.bincount(c.doc[a.inside], x[a.place[a.inside]], docs) + np.bincount(c.doc[a.tail], minlength=docs) * y
            known += np.bincount(c.doc[a.inside], minlength=docs)
            held_out = ~_ints(row.train, bool)
            out.append(pd.DataFrame({"doc_id": list(row.doc_id), "held_out": held_out, "n_tokens": c.lengths - 1, "n_known": np.rint(known).astype(np.int64), "base_score": base, "score": score}))
        return pd.concat(out) if out else pd.DataFrame(columns=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return each


def score(docs: DataFrame, least: int = 10, penalty: float = 2.0, longest: int = 4, head: int = 150_000, smooth: float = 0.1, rounds: int = 3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per input row.

    Chunks ask in ``rounds``, one after the other, so that only a part of what is asked and answered is on disk at a time.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix-tree")
    kind = docs.schema["doc_id"].dataType.simpleString()
    store = scratch.put(chunked(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", is_training(F.col("doc_id")).alias("train"))), compression="zstd")
    vocabulary = scratch.put(store.mapInPandas(_count_words, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    total = vocabulary.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"), F.count_if(F.col("n") == 1).alias("once")).first()
    n, v = total["n"] or 0, total["v"]
    if not n:
        plain = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long") + 1
        return docs.select("doc_id", (~is_training(F.col("doc_id"))).alias("held_out"), plain.alias("n_tokens"), F.lit(0).cast("long").alias("n_known"), F.lit(0).cast("long").alias("train_tokens"), F.lit(None).cast("double").alias("base_score"), F.lit(None).cast("double").alias("score"))
    z = n + smooth * (v + 1)
    known = 1 - (total["once"] + 0.5) / (n + 1)  # the share of known words; the rest is that of unknown ones
    bits = max(6, (n >> 22).bit_length())
    words_back, weights, depth = grow(store, scratch, vocabulary, n, known, least, penalty, longest, bits)
    scratch.release()
    log_base = F.log10((F.col("n") + smooth) / F.lit(float(z)))
    log_own = F.log10(F.col("n") / F.lit(float(n)) * F.lit(float(known)))
    #: A word is a symbol once and once the context of the next; the end is the context of a text's first symbol.
    lexicon = scratch.put(vocabulary.join(words_back, "h", "left").select("h", "n", log_base.alias("base"), (log_own + F.coalesce("back", F.lit(0.0))).alias("own")))
    rest = float(np.log10(1 - known)), float(np.log10(smooth / z))
    share = spark.sparkContext.broadcast
    head_of, bits_of = share(most_used(lexicon, "n", head, ["h", "base", "own"])), share(sieves(weights))
    #: Words outside the head: what they have beyond the share of unknown ones.
    table = lexicon.select(F.col("h").alias("key"), (F.col("own") - rest[0]).alias("weight"), (F.col("base") - rest[1]).alias("base"), F.lit(True).alias("known"))
    table = table.unionAll(weights.select("key", "weight", F.lit(0.0).alias("base"), F.lit(False).alias("known"))).withColumn("bucket", F.shiftrightunsigned("key", 64 - bits))
    told = []
    for i in range(rounds):
        part = store.where(F.pmod(F.xxhash64("chunk"), F.lit(rounds)) == i)
        asks = part.mapInPandas(_ask(head_of, bits_of, depth, bits), "bucket long, chunk long, keys binary")
        answers = scratch.put(asks.groupBy("bucket").cogroup(table.groupBy("bucket")).applyInPandas(_answer, "bucket long, chunk long, found binary, words binary, weights binary, bases binary"))
        scratch.release()
        told.append(scratch.put(part.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(_tell(head_of, bits_of, depth, bits, rest), "doc_id string, held_out boolean, n_tokens long, n_known long, base_score double, score double")))
        scratch.drop(answers)
        scratch.release()
    scratch.drop(store, vocabulary, words_back, weights, lexicon)
    out = reduce(DataFrame.unionAll, told)
    return out.select(F.col("doc_id").cast(kind).alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
