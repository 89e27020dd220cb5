"""MinHash near-dedup as a chosen-path set similarity join.

Documents are sets of word shingles. Equal sets fall together first. The others get ``POSITIONS`` minwise tokens and
descend independent trees: a node picks one of the positions, and a second one with the chance that makes 1 / threshold
on average, and a document goes to the child named by its token there. Nodes are counted from the second level on.
Those of at most ``small`` documents are compared exhaustively, larger ones branch on. Two documents just at the
threshold have one common child on average; how often none is left after ``levels`` levels says how many trees reach
``recall``.

Documents that link to each other do not part by branching. So the blocks of a large node are compared before it
branches, and where one class holds the node, but for a few documents, it is closed: those few are compared with all
its blocks. Nodes still large at the last level are closed alike, so no pair of a node is left out.

Sketches (one byte a position) choose pairs; their components are units, however large. Inside a unit every pair within
``slack`` of the threshold is confirmed on full sets, best estimates first, until what is linked is joined: in one task,
or in blocks that all documents outside the unit's main class visit. A unit of many classes that would need more than
``visits`` copies of its documents is confirmed in its trees' nodes instead.

Defined cases: an empty or null text has an empty set and is linked with nothing; rows with the same id are one
document, so all texts of an id are in one component (n_shingles is the row's own); rows without an id are linked
with nothing, have no component and are kept; equal sets are one class; a table without rows gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterscope.llm.common import Scratch, passes, sieve

POSITIONS = 128
_RNG = np.random.default_rng(11)
_MUL = (_RNG.integers(1, 1 << 31, POSITIONS, np.uint32) * 2 + 1).astype(np.uint32)
_ADD = _RNG.integers(0, 1 << 32, POSITIONS, np.uint32)
_WORD = (_RNG.integers(1, 1 << 62, 64, np.uint64) * 2 + 1).astype(np.uint64)
#: Bytes of a text that are hashed at once, unless one word is longer.
PIECE = 1 << 16
#: What a byte counts in a word's hash, A-Z like a-z; bytes between words.
_LETTER = _RNG.integers(0, 1 << 63, 256, np.uint64) * 2 + 1
_LETTER[65:91] = _LETTER[97:123]
_BLANK = np.isin(np.arange(256), [32, *range(9, 14)])
#: How far below the threshold an estimate may lie: over four standard deviations, so about 2 of 100,000 links at just the threshold have none.
SLACK = 0.16
#: Shingles of full sets that one task compares at a time (8 bytes each).
FULL = 4_000_000


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2 ** 64."""
    base = [0x9E3779B97F4A7C13, pow(0x9E3779B97F4A7C13, -1, 1 << 64)]
    up, down = (np.cumprod(np.append(np.uint64(1), np.full(n - 1, x, np.uint64))) for x in base)
    return up, down


_UP, _DOWN = _powers(PIECE)


def _hashed(piece: np.ndarray) -> np.ndarray:
    """The words' hashes: sums of their letters' numbers times powers by place, from running sums over the bytes."""
    up, down = (_UP, _DOWN) if len(piece) <= PIECE else _powers(len(piece))
    blank = np.concatenate(([True], _BLANK[piece], [True]))
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    start, end = edges[::2], edges[1::2]
    total = np.zeros(len(piece) + 1, np.uint64)
    np.cumsum(_LETTER[piece] * up[: len(piece)], out=total[1:])
    h = (total[end] - total[start]) * down[start]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def words(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's words in lower case (A-Z), in order; a piece of the text at a time, cut at a blank."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    found, at = [np.zeros(0, np.uint64)], 0
    while at < len(data):
        end = at + PIECE
        if end < len(data):
            near = np.flatnonzero(_BLANK[data[at:end]])
            while not len(near) and end < len(data):  # one word fills the piece
                near = np.flatnonzero(_BLANK[data[end : end + PIECE]]) + end - at
                end += PIECE
            end = at + int(near[-1]) + 1 if len(near) else len(data)
        found.append(_hashed(data[at:end]))
        at = end
    return np.concatenate(found)


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    w = words(text)
    if not len(w):
        return w
    if len(w) < size:
        h = np.array([int(x) for x in [(w * _WORD[: len(w)]).sum() ^ _WORD[63 - len(w)]]], np.uint64)
    else:
        h = np.zeros(len(w) - size + 1, np.uint64)
        for k in range(size):
            h += w[k : len(w) - size + 1 + k] * _WORD[k]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h.sort()
    return h[np.append(True, h[1:] != h[:-1])]


def minwise(u: np.ndarray) -> np.ndarray:
    """The least of each position's hash over a set: its minwise tokens."""
    x = (u >> np.uint64(32)).astype(np.uint32)
    out = np.full(POSITIONS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        out = np.minimum(out, (_MUL[:, None] * x[None, at : at + 2048] + _ADD[:, None]).min(axis=1))
    return out


def name_of(u: np.ndarray) -> int:
    """A set's name: 64 bits."""
    h = xxhash.xxh3_64_intdigest(u.tobytes())
    return h - (1 << 64) if h >> 63 else h


def full_sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """key, set: the whole sets of the texts of these ids, and of a few others that a bit map of bounded size lets pass."""
    hashed = lambda c: F.xxhash64(F.col(c).cast("long"))
    shared = docs.sparkSession.sparkContext.broadcast(sieve(ids.select(hashed("rep").alias("key"))))

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            sets = [shingles(t, size) for t in pdf["text"][passes(shared.value, pdf["h"].to_numpy(np.int64))]]
            yield pd.DataFrame({"key": np.array([name_of(u) for u in sets], np.int64), "set": [u.tobytes() for u in sets]})

    return docs.where("doc_id is not null").select(hashed("doc_id").alias("h"), "text").mapInPandas(each, "key long, set binary")


def mixed(*parts: np.ndarray) -> np.ndarray:
    """One 63-bit hash of several integer arrays."""
    h = np.full(1, 0x8445D61A4E774912, np.uint64)
    for p in parts:
        h = (h ^ np.asarray(p).astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        h = h ^ (h >> np.uint64(32))
    return (h >> np.uint64(1)).astype(np.int64)


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, key (the set's name), tokens, sig (their lowest bytes: the sketch); without shingles the key is null and there are no tokens."""

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            told = [of(shingles(t, size)) for t in pdf["text"]]  # a set goes before the next one is made
            n, key, tokens, sig = zip(*told, strict=True) if told else ((),) * 4
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_shingles": n, "key": pd.array(key, "Int64"), "tokens": tokens, "sig": sig})

    def of(u: np.ndarray) -> tuple[int, int | None, bytes | None, bytes | None]:
        if not len(u):
            return 0, None, None, None
        tokens = minwise(u).astype("<u4")
        return len(u), name_of(u), tokens.tobytes(), tokens.view(np.uint8)[::4].tobytes()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(each, "doc_id long, n_shingles long, key long, tokens binary, sig binary")


def _tokens(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint32).reshape(len(column), POSITIONS)


def lost(levels: int, threshold: float) -> float:
    """The chance that a pair at the threshold has no common node after so many levels of one tree."""
    second, out = 1 / threshold - 1, 0.0
    for _ in range(levels):
        out = (1 - threshold * (1 - out)) * (1 - second * threshold * (1 - out))
    return out


def trees_for(recall: float, levels: int, threshold: float) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(lost(levels, threshold))))


def descend(node: np.ndarray, row: np.ndarray, tokens: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(children, their rows): each node picks one position, and a second with the chance that makes 1 / threshold."""
    found = []
    for turn in (0, 1):
        h = mixed(node, np.uint64(turn + 1))
        on = np.ones(len(h), bool) if turn == 0 else (h >> 20) % 10_000 < 10_000 * (1 / threshold - 1)
        i = h[on] % POSITIONS
        found.append((mixed(node[on], i, tokens[row[on], i]), row[on]))
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def roots(sets: DataFrame, trees: int, threshold: float, level: int) -> DataFrame:
    """node, key: the nodes of all trees at the first level that is counted."""

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if len(pdf):
                tokens, key = _tokens(pdf["tokens"]), pdf["key"].to_numpy()
                for tree in range(trees):
                    node, row = np.full(len(key), int(mixed(np.uint64(tree))[0])), np.arange(len(key))
                    for _ in range(level):
                        node, row = descend(node, row, tokens, threshold)
                    yield pd.DataFrame({"node": node, "key": key[row]})

    return sets.select("key", "tokens").mapInPandas(each, "node long, key long")


def children(rows: DataFrame, threshold: float) -> DataFrame:
    """rows: node, key, tokens."""

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if len(pdf):
                node, row = descend(pdf["node"].to_numpy(), np.arange(len(pdf)), _tokens(pdf["tokens"]), threshold)
                yield pd.DataFrame({"node": node, "key": pdf["key"].to_numpy()[row]})

    return rows.select("node", "key", "tokens").mapInPandas(each, "node long, key long")


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimates from one byte a position; equal bytes by chance are taken off."""
    same = np.count_nonzero(a == b, axis=-1) / a.shape[-1]
    return (same - 1 / 256) / (1 - 1 / 256)


def _forest(i: np.ndarray, j: np.ndarray, est: np.ndarray, sets: list[np.ndarray] | None, percent: int) -> list[int]:
    """Positions of the pairs that make a spanning forest, best estimates first; with sets, of those that are links on them."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    out = []
    order = np.lexsort((j, i, -est))
    for k, a, b in zip(order.tolist(), i[order].tolist(), j[order].tolist(), strict=True):
        x, y = root(a), root(b)
        if x != y and (sets is None or linked(sets[a], sets[b], percent)):
            parent[x] = y
            out.append(k)
    return out


def _stars(i: np.ndarray, j: np.ndarray, ids: np.ndarray, wide: np.ndarray) -> pd.DataFrame:
    """What the pairs join, as stars around the least id of those that are in all blocks, or of all if there is none such."""
    rank = np.empty(len(ids), int)
    rank[np.lexsort((ids, ~wide))] = np.arange(len(ids))
    to = {x: x for x in {*i.tolist(), *j.tolist()}}

    def root(x: int) -> int:
        while to[x] != x:
            to[x] = x = to[to[x]]
        return x

    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            x, y = (x, y) if rank[x] < rank[y] else (y, x)
            to[y] = x
    at = np.array(list(to), int)
    center = np.array([root(x) for x in to], int)
    return pd.DataFrame({"a": ids[center[at != center]], "b": ids[at[at != center]]})


def _compare(threshold: float, slack: float, exact: bool):
    """Spanning stars of a node's documents under different labels whose sketches may reach the threshold.

    exact: of those that do on full sets, which the rows then hold; nothing else leaves the task.
    """
    percent = round(100 * threshold)

    def group(ids: np.ndarray, wide: np.ndarray, size: np.ndarray, label: np.ndarray, sig: np.ndarray, sets: list[np.ndarray] | None) -> pd.DataFrame:
        found = []
        step = max(1, 16_000_000 // (len(ids) * POSITIONS))
        for at in range(0, len(ids), step):
            part = slice(at, at + step)
            fit = np.minimum(size[part, None], size) >= threshold * np.maximum(size[part, None], size)
            fit &= (label[part, None] != label) & (np.arange(at, at + len(ids[part]))[:, None] < np.arange(len(ids)))
            r, c = np.nonzero(fit)
            for k in range(0, len(r), 100_000):
                rr, cc = r[k : k + 100_000] + at, c[k : k + 100_000]
                est = _estimates(sig[rr], sig[cc])
                ok = est >= threshold - slack
                found.append((rr[ok], cc[ok], est[ok]))
            if not exact and sum(len(f[0]) for f in found) > 500_000:
                found = [chosen(*map(np.concatenate, zip(*found, strict=True)), None)]
        if not found:
            return empty
        i, j, _ = chosen(*map(np.concatenate, zip(*found, strict=True)), sets)
        return _stars(i, j, ids, wide)

    def chosen(i: np.ndarray, j: np.ndarray, est: np.ndarray, sets: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keep = np.array(_forest(i, j, est, sets, percent), int)
        return i[keep], j[keep], est[keep]

    empty = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by (node, chunk); a group may reach over batches."""
        held: pd.DataFrame | None = None
        for pdf in parts:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            last = (pdf["node"].iloc[-1], pdf["chunk"].iloc[-1])
            own = ((pdf["node"] == last[0]) & (pdf["chunk"] == last[1])).to_numpy()
            held, pdf = pdf[own], pdf[~own]
            if len(pdf):
                yield work(pdf)
        if held is not None and len(held):
            yield work(held)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        node, chunk = pdf["node"].to_numpy(), pdf["chunk"].to_numpy()
        ids, wide, size, label = (pdf[k].to_numpy() for k in ("key", "everywhere", "n", "label"))
        sig = np.frombuffer(b"".join(pdf["sig"]), np.uint8).reshape(len(pdf), POSITIONS)
        sets = [np.frombuffer(x, np.uint64) for x in pdf["set"]] if exact else None
        first = np.append(True, (np.diff(node) != 0) | (np.diff(chunk) != 0))
        run = np.cumsum(first) - 1
        starts = np.flatnonzero(first)
        long = np.diff(np.append(starts, len(ids)))
        out, few = [], long[run] <= 24
        pairs = []
        for d in range(1, min(24, len(ids))):  # pairs of all small groups at once
            i = np.flatnonzero((run[:-d] == run[d:]) & few[:-d])
            if not len(i):
                break
            j = i + d
            ok = (np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j])) & (label[i] != label[j])
            i, j = i[ok], j[ok]
            est = _estimates(sig[i], sig[j])
            ok = est >= threshold - slack
            pairs.append((i[ok], j[ok], est[ok]))
        if pairs:
            i, j, _ = chosen(*map(np.concatenate, zip(*pairs, strict=True)), sets)
            out.append(_stars(i, j, ids, wide))
        for g in np.flatnonzero(long > 24):
            part = slice(starts[g], starts[g] + long[g])
            out.append(group(ids[part], wide[part], size[part], label[part], sig[part], sets[part] if exact else None))
        return pd.concat(out).drop_duplicates() if out else empty

    return each


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """id, to: the least id of each end's component. Every round sends each end to its least neighbour's least one and merges edges, all as tables."""
    edges, steps = scratch.put(edges.where("a <> b").distinct()), []
    if edges.isEmpty():
        return edges.select(F.col("a").alias("id"), F.col("b").alias("to"))
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("to"))
        hop = least.select(F.col("id").alias("_h"), F.col("to").alias("_t"))
        step = scratch.put(least.join(hop, F.col("to") == F.col("_h")).select("id", F.col("_t").alias("to")))
        steps.append(step)
        move = step.select(F.col("id").alias("_h"), F.col("to").alias("_t"))
        moved = edges.join(move, F.col("a") == F.col("_h")).select(F.col("_t").alias("a"), "b")
        moved = moved.join(move, F.col("b") == F.col("_h")).select(F.least("a", "_t").alias("a"), F.greatest("a", "_t").alias("b"))
        after = scratch.put(moved.where("a <> b").distinct())
        scratch.drop(edges)
        edges = after
    labels = steps[0]
    for step in steps[1:]:
        move = step.select(F.col("id").alias("_h"), F.col("to").alias("_t"))
        labels = labels.join(move, F.col("to") == F.col("_h"), "left").select("id", F.coalesce("_t", "to").alias("to"))
    return scratch.put(labels) if len(steps) > 1 else labels


def near_labels(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """id, to: two steps towards the least id of the component. Equal ones mean one component; where some documents are in all blocks, most of a class has one."""
    both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = scratch.put(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("to")))
    return least.join(least.select(F.col("id").alias("_h"), F.col("to").alias("_t")), F.col("to") == F.col("_h")).select("id", F.col("_t").alias("to"))


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on full sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < percent * len(y):
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def compared(rows: DataFrame, threshold: float, slack: float, exact: bool = False) -> DataFrame:
    """a, b: pairs of different labels in one node that may reach the threshold; exact: that do, on the sets in the rows.

    rows: node, blocks, key, label, everywhere, n, sig (and set). A node in several blocks has a document in the block of
    its hash, or in all of them if it is to be everywhere.
    """
    own = F.array(F.pmod(F.xxhash64("key", F.lit(1)), F.col("blocks")).cast("int"))
    chunks = F.when((F.col("blocks") > 1) & F.col("everywhere"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(own)
    rows = rows.select("node", F.explode(chunks).alias("chunk"), "key", "label", "everywhere", "n", "sig", *(["set"] if exact else []))
    rows = rows.repartition("node", "chunk").sortWithinPartitions("node", "chunk")
    return rows.mapInPandas(_compare(threshold, slack, exact), "a long, b long")


def _some() -> Column:
    """Sixteen documents of a node or so, to be in all its blocks while nothing is known of its classes."""
    return F.pmod(F.xxhash64("key"), F.col("members")) < 16


def with_classes(rows: DataFrame, labels: DataFrame, visits: int) -> DataFrame:
    """rows (node, key, members, blocks) and label, everywhere (it is outside the node's main class), differ (the node has several classes), closed."""
    rows = rows.join(labels.withColumnsRenamed({"id": "key", "to": "label"}), "key", "left").withColumn("label", F.coalesce("label", "key"))
    held = rows.groupBy("node", "label").agg(F.count(F.lit(1)).alias("_n"))
    main = held.groupBy("node").agg(F.max_by("label", F.struct("_n", "label")).alias("_main"), F.max("_n").alias("_top"), F.min("label").alias("_low"), F.max("label").alias("_high"))
    rows = rows.join(main, "node")
    closed = (F.col("members") - F.col("_top")) * F.col("blocks") <= visits * F.col("members")
    return rows.withColumns({"everywhere": F.col("label") != F.col("_main"), "differ": F.col("_low") < F.col("_high"), "closed": closed}).drop("_main", "_top", "_low", "_high")


def branched(sets: DataFrame, scratch: Scratch, trees: int, threshold: float, slack: float, small: int, levels: int, first: int, visits: int) -> tuple[DataFrame, DataFrame]:
    """(leaves, pairs): node, key, members, blocks of all nodes that ended, and the pairs whose sketches may reach the threshold."""
    sketch = sets.select("key", "n", "sig")
    blocks = F.ceil(F.col("members") / small).cast("int")
    leaves, pairs, labels = [], [], None
    rows = scratch.put(roots(sets, trees, threshold, first))
    for level in range(first, levels + 1):
        sized = rows.groupBy("node").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
        held = scratch.put(rows.join(sized, "node").withColumn("blocks", blocks))
        scratch.drop(rows)
        leaves.append(held.where("blocks = 1").withColumns({"label": F.col("key"), "everywhere": F.lit(False)}))
        large = held.where("blocks > 1")
        if large.isEmpty():
            break
        if labels is None:
            pairs.append(scratch.put(compared(large.join(sketch, "key").withColumns({"label": F.col("key"), "everywhere": _some()}), threshold, slack)))
            labels = scratch.put(near_labels(pairs[0], scratch))
        told = scratch.put(with_classes(large, labels, visits))
        ends = told.where("closed") if level < levels else told
        leaves.append(ends.select(*leaves[0].columns))
        rest = told.where("not closed")
        if level == levels or rest.isEmpty():
            break
        rows = scratch.put(children(rest.select("node", "key").join(sets.select("key", "tokens"), "key"), threshold))
    ended = _all(leaves)
    pairs.append(scratch.put(compared(ended.join(sketch, "key"), threshold, slack)))
    return ended.select("node", "key", "members", "blocks"), _all(pairs)


def confirmed(units: DataFrame, leaves: DataFrame, scratch: Scratch, threshold: float, slack: float, small: int, visits: int) -> DataFrame:
    """a, b: links that join all that is linked. units: node (the sketches' component), members, blocks, key, n, sig, set."""
    each = scratch.put(compared(units.withColumns({"label": F.col("key"), "everywhere": _some()}), threshold, slack, exact=True))
    large = units.where("blocks > 1")
    if large.isEmpty():
        return each
    told = scratch.put(with_classes(large.select("node", "key", "members", "blocks"), near_labels(each, scratch), visits))
    data = units.select("key", "n", "sig", "set")
    found = [each, scratch.put(compared(told.where("closed and differ").join(data, "key"), threshold, slack, exact=True))]
    rest = told.where("not closed").select("key", F.col("node").alias("unit"))
    if not rest.isEmpty():
        theirs = leaves.select("node", "key").join(rest, "key").select(F.xxhash64("node", "unit").alias("node"), "key")
        sized = theirs.join(data.select("key", "n"), "key").groupBy("node").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("_w")).where("members > 1")
        theirs = scratch.put(theirs.join(sized, "node").withColumn("blocks", _blocks(small)).drop("_w"))
        found.append(scratch.put(compared(theirs.join(data, "key").withColumns({"label": F.col("key"), "everywhere": _some()}), threshold, slack, exact=True)))
        cut = theirs.where("blocks > 1")
        if not cut.isEmpty():
            found.append(scratch.put(compared(with_classes(cut, near_labels(_all(found), scratch), visits).where("differ").join(data, "key"), threshold, slack, exact=True)))
    return _all(found)


def _blocks(small: int) -> Column:
    """Blocks of at most about ``small`` documents and FULL shingles."""
    return F.ceil(F.greatest(F.col("members") / small, F.col("_w") / FULL)).cast("int")


def near_duplicates(
    docs: DataFrame, size: int = 5, percent: int = 75, recall: float = 0.999, small: int = 400, levels: int = 4, slack: float = SLACK, visits: int = 4, unit: int = 1_000
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (it is its component's least id): one row per input row."""
    scratch = Scratch(docs.sparkSession, "near-dup")
    threshold = percent / 100
    bare = F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.lit("no shingles"), "doc_id"))
    rows = sketches(docs, size).withColumn("key", F.when(F.col("doc_id").isNotNull(), F.coalesce("key", bare)))
    rows = scratch.put(rows)
    sets = rows.where("tokens is not null and key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("tokens").alias("tokens"), F.first("sig").alias("sig"))
    sets = scratch.put(sets)
    keys = scratch.put(rows.select("doc_id", "n_shingles", "key"))
    scratch.drop(rows)
    several = keys.groupBy("doc_id").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a < b").select("doc_id", "a")
    same_id = scratch.put(keys.join(several, "doc_id").select("a", F.col("key").alias("b")).where("a <> b"))
    leaves, pairs = branched(sets, scratch, trees_for(recall, levels, threshold), threshold, slack, small, levels, min(2, levels), visits)
    coarse = components(pairs, scratch).withColumnsRenamed({"id": "key", "to": "node"})
    coarse = scratch.put(coarse.join(sets.select("key", "rep", "n", "sig"), "key"))
    sized = coarse.groupBy("node").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("_w"))
    units = coarse.drop("rep").join(sized, "node").withColumn("blocks", _blocks(unit)).drop("_w")
    units = scratch.put(full_sets(docs, coarse, size).join(units, "key").dropDuplicates(["key"]))
    links = confirmed(units, leaves, scratch, threshold, slack, small, visits).unionByName(same_id)
    classes = components(links, scratch)
    named = keys.join(classes.withColumnsRenamed({"id": "key", "to": "_c"}), "key", "left").withColumn("_c", F.coalesce("_c", "key"))
    least = named.where("_c is not null").groupBy("_c").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "_c", "left").select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
