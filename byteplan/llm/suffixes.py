"""Equal windows of a text by blockwise suffix sorting with a difference cover (numpy, one block at a time).

The suffixes of a block are sorted by their first ``PREFIX`` bytes. Suffixes that tie there are mostly
copies, with long common prefixes; comparing them byte by byte would be slow and keeping longer keys
would take memory. Instead the positions whose residue modulo 31 is in a perfect difference set (6 of
31) are ranked once. For any two suffixes there is a shift below 31 that brings both to ranked
positions, so two ties compare by one lookup each. The tie groups of a block are split around pivots, all
groups at once, until the members of each have equal rank.
"""

from __future__ import annotations

import numpy as np

#: Length of the strings that are compared, and of the keys that suffixes are sorted by at first.
WINDOW, PREFIX = 100, 32
#: A perfect difference set modulo 31; each non-zero residue is one difference.
COVER, MODULUS = (1, 5, 11, 24, 25, 27), 31
#: Bytes by which cover positions are ranked; with any shift, deeper than ``WINDOW``.
DEPTH = 104
#: Suffixes in one block.
BLOCK = 1 << 16

#: Buckets of window hashes, several times the windows of a block.
BUCKET_BITS = 20
_BASE = 0x9E3779B97F4A7C15

_IN_COVER = np.isin(np.arange(MODULUS), COVER)
_SHIFT = np.array([[next(d for d in range(MODULUS) if _IN_COVER[(a + d) % MODULUS] and _IN_COVER[(b + d) % MODULUS]) for b in range(MODULUS)] for a in range(MODULUS)])


def _sorted_groups(text: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings of ``length`` bytes at these places, and along it the number of each run of equal ones."""
    view = np.lib.stride_tricks.sliding_window_view(text, length)
    keys = np.ascontiguousarray(view[at]).view(f"S{length}").ravel()  # all of one length, so padding says nothing
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    return order, np.concatenate(([0], np.cumsum(ranked[1:] != ranked[:-1])))


def cover_ranks(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Rank of each cover position within a shift of a start by its next ``DEPTH`` bytes; -1 elsewhere."""
    size = int(starts.max()) + MODULUS + 1
    reach = np.zeros(size, np.int32)
    np.add.at(reach, starts, 1)
    np.add.at(reach, starts + MODULUS, -1)
    at = np.flatnonzero((np.cumsum(reach) > 0) & _IN_COVER[np.arange(size) % MODULUS])
    ranks = np.full(size, -1, np.int64)
    order, groups = _sorted_groups(text, at, DEPTH)
    ranks[at[order]] = groups
    return ranks


def sort_windows(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the windows at ``starts`` and, along it, class numbers: equal for equal strings.

    ``text`` must go on for ``DEPTH + MODULUS`` bytes after the last start (any padding will do).
    """
    order, group = _sorted_groups(text, starts, PREFIX)
    tied = np.bincount(group)[group] > 1
    if tied.any():
        places = np.flatnonzero(tied)
        ranks = cover_ranks(text, starts[order[places]])
        at, tie = starts[order[places]], group[places].astype(np.int64)
        draw = np.random.default_rng(len(at))
        while True:
            _, first, tie, size = np.unique(tie, return_index=True, return_inverse=True, return_counts=True)
            pivot = at[first + (draw.random(len(first)) * size).astype(np.int64)][tie]
            shift = _SHIFT[at % MODULUS, pivot % MODULUS]
            side = np.sign(ranks[at + shift] - ranks[pivot + shift])
            if not side.any():
                break
            tie = tie * 3 + side + 1
            again = np.argsort(tie, kind="stable")
            at, tie = at[again], tie[again]
            order[places] = order[places][again]
    ranked = starts[order]
    same = group[1:] == group[:-1]
    near = np.flatnonzero(same)
    view = np.lib.stride_tricks.sliding_window_view(text, WINDOW)
    for at in range(0, len(near), 1 << 13):
        part = near[at : at + (1 << 13)]
        same[part] = (view[ranked[part]] == view[ranked[part + 1]]).all(axis=1)
    return order, np.concatenate(([0], np.cumsum(~same)))


def repeated_windows(segments: list[bytes | memoryview], keys: np.ndarray, ranks: np.ndarray) -> list[np.ndarray]:
    """For each segment, which of its windows are equal to one of a segment of lower rank.

    ``keys`` tell groups of segments apart that cannot share a window; blocks are made of whole groups
    up to ``BLOCK`` windows (or one group). No segment holds two equal windows.
    """
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(segments)
    order = np.argsort(keys, kind="stable")
    block: list[int] = []
    size = 0
    for i, k in enumerate(order.tolist()):
        if block and size >= BLOCK and keys[k] != keys[block[-1]]:
            _block(segments, block, ranks, out)
            block, size = [], 0
        block.append(k)
        size += len(segments[k]) - WINDOW + 1
    if block:
        _block(segments, block, ranks, out)
    return out


def _block(segments: list[bytes | memoryview], block: list[int], ranks: np.ndarray, out: list[np.ndarray]) -> None:
    text = np.frombuffer(b"".join([*(segments[k] for k in block), bytes(DEPTH + 2 * MODULUS)]), np.uint8)
    for k in block:
        out[k] = np.zeros(len(segments[k]) - WINDOW + 1, bool)
    lengths = np.array([len(segments[k]) for k in block])
    counts = lengths - WINDOW + 1
    owner = np.repeat(np.arange(len(block)), counts)
    begin = np.cumsum(lengths) - lengths
    inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = begin[owner] + inner
    may = may_repeat(text, starts)
    if not may.any():
        return
    order, classes = sort_windows(text, starts[may])
    rank = ranks[np.array(block)][owner[may]][order]
    first = np.minimum.reduceat(rank, np.flatnonzero(np.concatenate(([True], classes[1:] != classes[:-1]))))
    found = np.empty(len(order), bool)
    found[order] = rank > first[classes]
    repeated = np.zeros(len(starts), bool)
    repeated[may] = found
    for k, part in zip(block, np.split(repeated, np.cumsum(counts)[:-1])):
        out[k] = part


def may_repeat(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """False for windows whose hash falls into a bucket of its own: they equal no other and need no sorting."""
    hashes, widths = [text.astype(np.uint64) + np.uint64(1)], [1]
    while widths[-1] * 2 <= WINDOW:
        h, w = hashes[-1], widths[-1]
        hashes.append(h[:-w] * np.uint64(pow(_BASE, w, 1 << 64)) + h[w:])
        widths.append(2 * w)
    whole, done = hashes.pop(), widths.pop()
    for h, w in zip(reversed(hashes), reversed(widths)):
        if done + w <= WINDOW:
            count = len(text) - done - w + 1
            whole = whole[:count] * np.uint64(pow(_BASE, w, 1 << 64)) + h[done : done + count]
            done += w
    bucket = ((whole[starts] * np.uint64(_BASE)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    return np.bincount(bucket, minlength=1 << BUCKET_BITS)[bucket] > 1
