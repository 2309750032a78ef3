"""Counts of the substrings that start in a slice of a blob, by sorted suffixes: memory goes with the slice, not the blob."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import numpy as np

from .dictionary import REF_COST

#: Bytes of a slice; a slice's arrays take about 80 times as many and should fit a cache.
SLICE = 1 << 18
#: Bytes by which all places are sorted; by more only where that may matter.
KNOWN = 14


def slices(data: bytes, longest: int, size: int = SLICE) -> Iterator[tuple[int, bytes]]:
    """(starts, bytes) of a blob: how many places belong to the slice, and its bytes with all that can start there."""
    for at in range(0, len(data), size):
        yield min(size, len(data) - at), data[at : at + size + longest]


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in order of their keys, and for each place the rank of its key; equal keys share one."""
    order = np.argsort(keys).astype(np.int32)
    found = keys[order]
    ranks = np.empty(len(keys), np.int32)
    ranks[order] = np.cumsum(np.append(0, found[1:] != found[:-1]), dtype=np.int32)
    return order, ranks


def _sorted(data: bytes, starts: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``starts`` places in order of their next 14 bytes; for every place a key of 7 bytes and the rank of 14.

    The end of the data comes before every byte: a place is nine bits of a key. Keys and ranks go on ``longest`` and 14
    places past the end.
    """
    n, past = len(data), longest + KNOWN
    units = np.zeros(n + past + 7, np.int64)
    units[:n] = np.frombuffer(data, np.uint8)
    units[:n] += 1
    keys = np.zeros(n + past, np.int64)
    for k in range(7):
        keys <<= 9
        keys |= units[k : k + n + past]
    ranks = _ranks(keys[: n + 7])[1].astype(np.int64)
    order, ranks = _ranks(ranks[:n] << 32 | ranks[7:])
    return order[order < starts], keys, np.append(ranks, np.full(past, -1, np.int32))


def _further(places: np.ndarray, ranks: np.ndarray, longest: int) -> np.ndarray:
    """The places in order of their next ``longest`` bytes."""
    found, order = ranks[places], None
    for by in (*range(KNOWN, longest - KNOWN, KNOWN), longest - KNOWN):
        order, found = _ranks(found.astype(np.int64) << 32 | (ranks[places + by] + 1))
    return places[order]


def _shared(order: np.ndarray, keys: np.ndarray, ranks: np.ndarray, longest: int) -> np.ndarray:
    """How many bytes, up to ``longest``, each place shares with the one before; 0 for the first."""
    a, b = order[:-1].astype(np.int64), order[1:].astype(np.int64)
    length, same = np.zeros(len(b), np.int32), np.ones(len(b), bool)
    for by in range(0, longest, KNOWN):
        same &= ranks[a + by] == ranks[b + by]
        length += KNOWN * same
    length = np.minimum(length, longest)
    length += 7 * (keys[a + length] == keys[b + length])
    differ = keys[a + length] ^ keys[b + length]
    for k in range(7):
        length += (differ >> (54 - 9 * k)) == 0
    return np.append(np.zeros(1, np.int32), np.minimum(length, longest))


def best_substrings(data: bytes, starts: int, shortest: int, longest: int, most: int, whole: bool) -> tuple[list[bytes], list[int], int]:
    """(patterns, counts, bound): up to ``most`` substrings that start in the slice twice or more, by count times what one saves.

    ``bound``: no other substring has more here. ``whole``: the slice is all of its blob, where a single place counts
    for nothing; in a part it may belong to a pattern that others repeat.
    """
    if not starts:
        return [], [], 0
    bound = 0 if whole else max(0, longest - REF_COST)
    order, keys, ranks = _sorted(data, starts, longest)
    shared = _shared(order, keys, ranks, min(longest, KNOWN))
    kept, known = np.zeros((0, 4), np.int64), KNOWN  # score, count, place, length
    for length in range(shortest, longest + 1):
        if length > known:  # longer ones save at most so much, and only few places may be among the best
            begins = np.flatnonzero(shared < KNOWN)
            counts = np.diff(np.append(begins, len(order)))
            scores = counts * (longest - REF_COST)
            good = (counts >= 2) & (scores > (kept[:, 0].min() if len(kept) == most and most else 0))
            bound = max(bound, int(scores[(counts >= 2) & ~good].max(initial=0)))
            order, known = _further(order[np.repeat(good, counts)], ranks, longest), longest
            shared = _shared(order, keys, ranks, longest) if len(order) else np.zeros(0, np.int32)
        begins = np.flatnonzero(shared < length)
        counts = np.diff(np.append(begins, len(order)))
        many = np.flatnonzero(counts >= 2)
        if not len(many):
            break
        counts, places = counts[many], order[begins[many]]
        scores = counts * (length - REF_COST)
        if len(kept) == most and most:
            good = scores > kept[:, 0].min()
            bound = max(bound, int(scores[~good].max(initial=0)))
            scores, counts, places = scores[good], counts[good], places[good]
        kept = np.concatenate([kept, np.stack([scores, counts, places, np.full(len(scores), length)], axis=1)])
        if len(kept) > most:
            cut = np.argpartition(-kept[:, 0], most) if most else np.arange(len(kept))
            bound = max(bound, int(kept[cut[most:], 0].max()))
            kept = kept[cut[:most]]
    return [data[p : p + n] for p, n in kept[:, 2:].tolist()], kept[:, 1].tolist(), bound


def count_substrings(data: bytes, starts: int, patterns: Sequence[bytes]) -> list[int]:
    """How often each of the patterns starts in the slice."""
    if not starts or not patterns:
        return [0] * len(patterns)
    longest = max(KNOWN, *map(len, patterns))
    order, _, ranks = _sorted(data, starts, longest)

    def among(order: memoryview, p: bytes) -> tuple[int, int]:
        n = len(p)
        key = lambda i: data[i : i + n]
        at = bisect_left(order, p, key=key)
        return at, bisect_right(order, p, lo=at, key=key)

    view = further = memoryview(order)
    if longest > KNOWN:
        of_long = np.zeros(len(order), bool)
        for p in {p[:KNOWN] for p in patterns if len(p) > KNOWN}:
            of_long[slice(*among(view, p))] = True
        further = memoryview(_further(order[of_long], ranks, longest))
    return [b - a for a, b in (among(further if len(p) > KNOWN else view, p) for p in patterns)]
