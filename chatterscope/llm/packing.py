"""Best-fit packing of token sequences by bin completion with branch and bound.

Documents are tokenized and cut into pieces; what packing needs of them is one number, so the search runs over
the histogram of piece lengths (at most ``capacity`` counts, whatever the input's size). Around the longest
piece that is left, the undominated fillings of the rest of its sequence are enumerated, least waste first and up to a
share of the effort a state; a filling is used as often as its lengths last, or once. Branches whose waste exceeds what the
best solution so far allows are pruned and others tried instead. Best-fit decreasing gives the first solution; descents that
take the most valuable filling around the longest piece, where a piece of length x is worth x to a power over one, give
others, since long pieces that are left to the end are what costs sequences. The result, patterns with multiplicities, is
turned into places by each piece's rank among the pieces of its length.

Defined cases: a null text is empty and has the end token alone; repeated rows are packed each; ties are
interchangeable rows; no rows give no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from chatterscope.llm.common import Scratch, dense_index


class Encoder:
    """A whole text's ids as little-endian 32-bit bytes.

    The ids are those of the same vocabulary's tokenizers file as it is loaded (tests compare them), its added tokens
    found inside texts; this library reads them four times as fast.
    """

    def __init__(self, ranks_path: str, added: dict[str, int]):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def ids(self, text: str) -> bytes:
        return np.array(self.encoding.encode(text, allowed_special="all"), "<u4").tobytes()


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_added() -> dict[str, int]:
    """The tokens that the tokenizers file adds to the vocabulary."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def cut(ids: bytes, capacity: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids; all pieces but the first are full."""
    n = len(ids) // 4
    first = n - (-(-n // capacity) - 1) * capacity
    out, at = [], 0
    while at < n:
        length = first if at == 0 else capacity
        out.append((len(out), at, length, zlib.crc32(ids[4 * at : 4 * (at + length)])))
        at += length
    return out


def pieces(docs: DataFrame, capacity: int, end_id: int, ranks_path: str | None) -> DataFrame:
    end = int(end_id).to_bytes(4, "little")

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(ranks_path, {}) if ranks_path else Encoder(default_ranks(), default_added())
        for pdf in parts:
            found = [(d, *p) for d, t in zip(pdf["doc_id"], pdf["text"], strict=True) for p in cut(encoder.ids(t or "") + end, capacity)]
            yield pd.DataFrame(found, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": pdf["doc_id"].dtype})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(each, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def lower_bound(counts: np.ndarray) -> int:
    """Sequences that any packing needs: by volume, and by pieces over half plus what cannot join them."""
    cap = len(counts) - 1
    n, volume = np.cumsum(counts), np.cumsum(np.arange(cap + 1) * counts)
    half, k = cap // 2, np.arange(cap // 2 + 1)
    over = cap - k
    wide, space = n[over] - n[half], (n[over] - n[half]) * cap - (volume[over] - volume[half])
    small = volume[half] - np.where(k > 0, volume[np.maximum(k - 1, 0)], 0)
    more = -(-(small - space) // cap)
    return max(-(-int(volume[cap]) // cap), int((n[cap] - n[over] + wide + np.maximum(more, 0)).max()))


def _spread(lengths: int, waste: int) -> int:
    """Bits t for which a length from t to t + waste is among ``lengths`` (bit sets, as all in this search)."""
    done = 0
    while done < waste:
        step = min(done + 1, waste - done)
        lengths |= lengths >> step
        done += step
    return lengths


class Effort:
    """Steps that a search has left: in all, and for the fillings of one state."""

    def __init__(self, steps: int, each: int):
        self.steps, self.each = steps, each


def greedy(left: np.ndarray, room: int) -> tuple[int, ...]:
    """The longest pieces that fit, one after the other."""
    out = []
    for x in np.flatnonzero(left[: room + 1])[::-1].tolist():
        n = min(int(left[x]), room // x)
        out += [x] * n
        room -= n * x
    return tuple(out)


def fillings(left: np.ndarray, room: int, most_waste: int, effort: Effort) -> Iterator[tuple[int, ...]]:
    """All undominated fillings of ``room`` from what is left that waste at most ``most_waste``: least waste first, longer pieces first.

    A filling is dominated if a piece that is left fits beside it, or can take the place of some of its pieces that are
    together no longer, or of one that is shorter. No packing gets worse by the exchange, so those are left out; as soon
    as some of the pieces of a filling can be exchanged, all that hold them are. Among many short pieces the next one may be
    far: a state's share of the effort ends the enumeration, and a state without any filling by then gets the greedy one.
    """
    steps = effort.each
    have = np.flatnonzero(left[: room + 1]).tolist()
    most = [min(int(left[x]), room // x) for x in have]
    reach = [1]  # sums that the first k lengths give
    for x, n in zip(have, most, strict=True):
        sums, k = reach[-1], 1
        while n > 0:
            sums |= sums << (min(k, n) * x)
            n, k = n - k, 2 * k
        reach.append(sums & ((2 << room) - 1))
    free = sum(1 << x for x in have)

    def search(upto: int, rest: int, waste: int, items: tuple[int, ...], free: int, one: int, sums: int, more: int) -> Iterator[tuple[int, ...]]:
        """one: chosen lengths; sums: of any of them; more: of two or more."""
        nonlocal steps
        steps -= 1
        effort.steps -= 1
        if steps < 0 or effort.steps < 0:
            return
        if _spread(free, waste) & more or (waste and _spread(free >> 1, waste - 1) & one):
            return
        if not rest:
            if not free & ((2 << waste) - 2):
                yield items
            return
        for j in range(min(upto, bisect.bisect_right(have, rest)) - 1, -1, -1):
            if not reach[j + 1] >> rest & 1:
                return
            x = have[j]
            for n in range(min(most[j], rest // x), 0, -1):
                if reach[j] >> (rest - n * x) & 1:
                    all_, several = sums, more
                    for _ in range(n):
                        several |= several << x | (all_ & ~1) << x
                        all_ |= all_ << x
                    yield from search(j, rest - n * x, waste, items + (x,) * n, free & ~(1 << x) if n == left[x] else free, one | 1 << x, all_, several)

    left, none = left.copy(), True
    for waste in range(min(most_waste, room) + 1):
        if reach[-1] >> (room - waste) & 1:
            for f in search(len(have), room - waste, waste, (), free, 0, 1, 0):
                none = False
                yield f
        if steps < 0 or effort.steps < 0:
            if none:
                yield greedy(left, room)
            return


def best_fit(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over the histogram, as patterns with multiplicities: the first incumbent."""
    cap = len(counts) - 1
    rooms: dict[int, list[list]] = {}
    order = [int(x) for x in np.flatnonzero(counts)[::-1]]
    for size in order:
        n = int(counts[size])
        for room in sorted(r for r in rooms if r >= size):
            while n and rooms.get(room):
                items, m = rooms[room].pop()
                k = room // size
                if n < m * k:
                    used = n // k
                    if used:
                        rooms.setdefault(room - k * size, []).append([items + [size] * k, used])
                    n -= used * k
                    if n:
                        rooms.setdefault(room - n * size, []).append([items + [size] * n, 1])
                        used, n = used + 1, 0
                    if m > used:
                        rooms[room].append([items, m - used])
                else:
                    rooms.setdefault(room - k * size, []).append([items + [size] * k, m])
                    n -= m * k
        if n:
            k = cap // size
            if n // k:
                rooms.setdefault(cap - k * size, []).append([[size] * k, n // k])
            if n % k:
                rooms.setdefault(cap - (n % k) * size, []).append([[size] * (n % k), 1])
    return [(tuple(items), m) for found in rooms.values() for items, m in found]


#: Powers of the descents: near one, waste decides; the higher, the sooner long pieces go together.
POWERS = (1.3, 1.05, 1.5)


def descent(counts: np.ndarray, power: float, share: int = 2, wide: int = 128) -> list[tuple[tuple[int, ...], int]]:
    """One way down: the filling of greatest value around the longest piece, ``1 / share`` as often as its lengths last.

    The rest of the pieces of these lengths stay for other fillings. After as many fillings as there are lengths each is
    used as often as it can be, which all but ends a length, so about twice as many fillings are made, whatever the counts. The best
    filling is a knapsack over the lengths that fit, or over ``wide`` of them, from the longest to the shortest, where more do.
    """
    cap = len(counts) - 1
    left, out = counts.copy(), []
    value = np.arange(cap + 1, dtype=float) ** power
    while left.any():
        size = int(np.flatnonzero(left)[-1])
        left[size] -= 1
        room, worth, took = cap - size, np.zeros(cap - size + 1), []
        have = np.flatnonzero(left[: room + 1])[::-1]
        if len(have) > wide:
            have = have[np.linspace(0, len(have) - 1, wide).astype(int)]
        for x in have.tolist():
            n, k = min(int(left[x]), room // x), 1
            while n > 0:  # one, two, four pieces and so on make any number of them
                m = min(k, n)
                with_it = worth[: room + 1 - m * x] + m * value[x]
                better = with_it > worth[m * x :]
                took.append((x, m, better))
                worth = np.concatenate((worth[: m * x], np.where(better, with_it, worth[m * x :])))
                n, k = n - m, 2 * k
        left[size] += 1
        items, at = [size], room
        for x, m, better in reversed(took):
            if at >= m * x and better[at - m * x]:
                items += [x] * m
                at -= m * x
        kinds, need = np.unique(items, return_counts=True)
        m = max(1, int((left[kinds] // need).min()) // (share if len(out) < cap else 1))
        left[kinds] -= m * need
        out.append((tuple(items), m))
    return out


def complete(counts: np.ndarray, nodes: int = 8_000, steps: int = 1_000_000, each: int = 400) -> list[tuple[tuple[int, ...], int]]:
    """Bin completion: patterns of lengths with multiplicities, as few sequences as the search finds.

    Depth first from the best of best fit's solution and the descents' as the incumbent: the longest piece that is left gets one undominated filling after
    the other, each as often as its lengths last and then once. A state is left if it was reached with as few sequences
    before, if what it wastes or its lower bound says that it cannot beat the incumbent, or when all its fillings are tried.
    ``nodes`` bounds the states, ``steps`` the choices tried in enumerating fillings, ``each`` those of one state; none of them
    bounds the pieces: whatever happens, the result packs all of them. Where no bound is reached the result is the least
    number of sequences.
    """
    cap = len(counts) - 1
    total = int(np.arange(cap + 1) @ counts)
    least, best = lower_bound(counts), best_fit(counts)
    n_best = sum(m for _, m in best)
    for power in POWERS:
        if n_best > least:
            other = descent(counts, power)
            n_other = sum(m for _, m in other)
            if n_other < n_best:
                best, n_best = other, n_other
    left, chosen, used = counts.copy(), [], 0
    reached: dict[bytes, int] = {}
    effort = Effort(steps, each)

    def moves() -> Iterator[tuple[np.ndarray, np.ndarray, tuple[int, ...], int]]:
        size = int(np.flatnonzero(left)[-1])
        left[size] -= 1
        own = left.copy()
        left[size] += 1
        for f in fillings(own, cap - size, spare(), effort):
            items = (size, *f)
            kinds, need = np.unique(items, return_counts=True)
            most = int((left[kinds] // need).min())
            for m in (most, 1) if most > 1 else (1,):
                yield kinds, need, items, m

    def spare() -> int:
        """What may be wasted from here on in a packing that beats the incumbent."""
        return (n_best - 1 - used) * cap - int(np.arange(cap + 1) @ left)

    def undo() -> None:
        nonlocal used
        kinds, need, _, m = chosen.pop()
        left[kinds] += m * need
        used -= m

    stack = [moves()] if n_best > least else []
    while stack and nodes > 0 and n_best > least:
        move = next(stack[-1], None)
        if move is None:
            stack.pop()
            if chosen:
                undo()
            continue
        kinds, need, items, m = move
        if m * (cap - sum(items)) > spare():
            continue
        left[kinds] -= m * need
        chosen.append(move)
        used += m
        state = hashlib.blake2b(left.tobytes(), digest_size=16).digest()
        if reached.get(state, n_best) <= used:
            undo()
            continue
        reached[state] = used
        nodes -= 1
        if not left.any():
            best, n_best = [(items, m) for _, _, items, m in chosen], used
            undo()
        elif used + lower_bound(left) >= n_best:
            undo()
        else:
            stack.append(moves())
    return best


def pack(docs: DataFrame, capacity: int = 1024, end_id: int = 2, ranks_path: str | None = None, nodes: int = 8_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: each piece's place."""
    scratch = Scratch(docs.sparkSession, "packing")
    rows = scratch.put(pieces(docs, capacity, end_id, ranks_path))
    counts = np.zeros(capacity + 1, int)
    for r in rows.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["count"]
    patterns = complete(counts, nodes=nodes)
    #: By length: patterns' first ranks, first sequences, pieces of it in one, and where their offsets begin in ``offsets``.
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    seq, filled, offsets = 0, dict.fromkeys(range(capacity + 1), 0), []
    for items, m in patterns:
        ends = np.cumsum(items)
        for x in set(items):
            at = [int(e) - x for e, y in zip(ends, items, strict=True) if y == x]
            slots.setdefault(x, []).append((filled[x], seq, len(at), len(offsets)))
            offsets += at
            filled[x] += m * len(at)
        seq += m
    shared = docs.sparkSession.sparkContext.broadcast(({x: np.array(v).T for x, v in slots.items()}, np.array(offsets, np.int64)))  # a few numbers a pattern; patterns are bounded by the lengths and nodes

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lookup, at = shared.value
        for pdf in parts:
            sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            length, rank = pdf["length"].to_numpy(), pdf["_rank"].to_numpy()
            for x in np.unique(length):
                own = np.flatnonzero(length == x)
                first, base, k, begin = lookup[int(x)]
                i = np.searchsorted(first, rank[own], "right") - 1
                r = rank[own] - first[i]
                sequence[own], offset[own] = base[i] + r // k[i], at[begin[i] + r % k[i]]
            yield pdf.drop(columns="_rank").assign(sequence_id=sequence, offset=offset)

    ranked = dense_index(rows, ["length"], ["doc_id", "piece", "ids_crc32"], int(counts.sum()), "_rank")
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "_rank")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.mapInPandas(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
