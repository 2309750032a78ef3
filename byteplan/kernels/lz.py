"""Two greedy LZ77 parses and what they tell about the data.

The best match of every position is found before parsing, in NumPy: positions are sorted by what their candidates
share, and all positions, of many blobs together, try their next candidate at once, until none has any left that
could be better. A long blob is searched block by block, each with the window before it and the longest match after it,
so memory is bounded by the block. The parse itself only steps from match to match. ``parse`` prefers the nearest of equally long matches among at most 64
candidates in 32 KiB; ``parse_far`` takes the farthest of the longest among all in its window.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import takewhile
from typing import NamedTuple

import numpy as np

from . import leb
from .vm import CPY, ELIT, HALT, LIT, LOOP, MAP, decode_at

#: Window, shortest and longest match, candidates that are tried.
WINDOW, MIN_MATCH, MAX_MATCH, MAX_TRIES = 1 << 15, 4, 258, 64
#: Fixed value: multiplier of the 16-bit hash by which candidates are found.
MULTIPLIER = 0x9E3779B9


class Token(NamedTuple):
    """``offset`` 0 is a literal of ``length`` bytes at ``start``; else a copy from that far back."""

    start: int
    length: int
    offset: int = 0

    @property
    def kind(self) -> str:
        return "CPY" if self.offset else "LIT"


def _words(data: bytes) -> np.ndarray:
    """The eight bytes from each position as a number, least byte first; zeros follow the data, enough for any match."""
    padded = np.frombuffer(data + bytes(MAX_MATCH + 16), np.uint8)
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)).view("<u8").ravel()


def _common(words: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of pairs of positions, at most ``most`` each."""
    out = np.zeros(len(a), np.int64)
    left = np.arange(len(a))
    while len(left):
        x = words[a[left] + out[left]] ^ words[b[left] + out[left]]
        out[left] += np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3)
        left = left[(x == 0) & (out[left] < most[left])]
    return np.minimum(out, most)


#: Bytes of blobs that are searched together.
TOGETHER = 1 << 19


#: Where a blob is searched: data of one block or of blobs laid end to end, their starts (and the end), the first and last position looked at.
_Block = tuple[bytes, np.ndarray, int, int]


def _matches(block: _Block, keys: np.ndarray, window: int, shortest: int, tries: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Length and distance of the best match of each position of a block from its first to its last.

    Lengths under ``shortest`` are no matches (distance 0). With ``tries``, from the nearest candidate back, at most so
    many; without, from the farthest. The first of equally long ones stays.
    """
    data, starts, low, high = block
    n, words = len(keys), _words(data)
    begin = np.repeat(starts[:-1], np.diff(starts))[:n]
    most = np.minimum(np.repeat(starts[1:], np.diff(starts))[:n] - np.arange(n), MAX_MATCH)
    order = np.argsort(keys, kind="stable")
    group = np.cumsum(np.concatenate(([0], keys[order][1:] != keys[order][:-1]))) << 40
    rank, first = np.empty(n, np.int64), np.empty(n, np.int64)
    rank[order] = np.arange(n)
    first[order] = np.searchsorted(group + order, group + np.maximum(order - window, begin[order]))
    del begin, group
    best, distance = np.full(n, shortest - 1, np.int64), np.zeros(n, np.int64)
    raw = words.astype(np.uint8)  # the byte at each position
    at = low + np.flatnonzero((rank[low:high] > first[low:high]) & (most[low:high] >= shortest))
    end, place = (rank - first)[at], rank[at] - 1 if tries else first[at]
    del rank, first
    if tries:
        end = np.minimum(end, tries)
    longest, step = best[at], 0
    while len(at):
        candidate = order[place - step if tries else place + step]
        hopeful = np.flatnonzero(raw[candidate + longest] == raw[at + longest])
        a, c = at[hopeful], candidate[hopeful]
        length = _common(words, c, a, most[a])
        better = length > longest[hopeful]
        a, length, hopeful = a[better], length[better], hopeful[better]
        best[a], distance[a], longest[hopeful] = length, a - c[better], length
        step += 1
        end[hopeful[length == most[a]]] = 0  # nothing can be longer
        left = end > step
        if not left.all():
            at, place, end, longest = at[left], place[left], end[left], longest[left]
    return best[low:high], distance[low:high]


def _together(blobs: Iterable[bytes], window: int, after: int) -> Iterator[tuple[list[int], bool, _Block]]:
    """Lengths of the blobs that a block has parts of, whether it goes on with a blob begun before, and the block.

    Neighbouring blobs of up to ``TOGETHER`` bytes lie end to end in one block. A longer one has blocks of its own, with
    ``window`` bytes before each and ``after`` bytes behind it.
    """
    group, size = [], 0

    def close() -> tuple[list[int], bool, _Block]:
        lengths = [*map(len, group)]
        return lengths, False, (b"".join(group), np.cumsum([0, *lengths]), 0, size)

    for blob in blobs:
        if group and size + len(blob) > TOGETHER:
            yield close()
            group, size = [], 0
        if len(blob) <= TOGETHER:
            group.append(blob)
            size += len(blob)
            continue
        for a in range(0, len(blob), TOGETHER):
            low, b = max(0, a - window), min(len(blob), a + TOGETHER)
            data = blob[low : b + after]
            yield [b - a], a > 0, (data, np.array([0, len(data)]), a - low, b - low)
    if group:
        yield close()


def _greedy(begin: int, covered: int, best: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, int]:
    """Take each match that begins where the one before has ended or later; the rest is literal.

    Tokens (start, length, offset) from ``covered`` on to the last match that begins in a block (``begin`` is its first
    place in its blob), and where they end.
    """
    places = np.flatnonzero(distance)
    lengths, offsets, places = best[places], distance[places], begin + places
    following, k, taken = np.searchsorted(places, places + lengths).tolist(), int(np.searchsorted(places, covered)), []
    while k < len(following):
        taken.append(k)
        k = following[k]
    if not taken:
        return np.empty((0, 3), np.int64), covered
    out = np.zeros((len(taken), 2, 3), np.int64)  # the literal before each match, and the match
    out[:, 1, 0], out[:, 1, 1], out[:, 1, 2] = places[taken], lengths[taken], offsets[taken]
    ends = out[:, 1, 0] + out[:, 1, 1]
    out[0, 0, 0], out[1:, 0, 0] = covered, ends[:-1]
    out[:, 0, 1] = out[:, 1, 0] - out[:, 0, 0]
    out = out.reshape(-1, 3)
    return out[out[:, 1] > 0], int(ends[-1])


def _parts(blobs: Sequence[bytes], keys: Callable[[bytes], np.ndarray], window: int, shortest: int, tries: int | None) -> Iterator[Iterator[np.ndarray]]:
    """The parse of each blob in parts, one for each of its blocks; a blob's parts are to be taken before the next blob's.

    A part has a row (start, length, offset) for each token.
    """
    blocks = _together(blobs, window, max(MAX_MATCH, shortest) + 8)

    def tokens() -> Iterator[np.ndarray | None]:
        """The parts of all blobs; None ends a blob."""
        sizes, done, covered = iter(blobs), 0, 0
        for lengths, goes_on, block in blocks:
            best, distance = _matches(block, keys(block[0]), window, shortest, tries)
            a = 0
            for length in lengths:
                if not goes_on:
                    n, done, covered = len(next(sizes)), 0, 0
                found, covered = _greedy(done, covered, best[a : a + length], distance[a : a + length])
                a, done = a + length, done + length
                if done == n and covered < n:
                    found = np.append(found, [(covered, n - covered, 0)], 0)
                yield found
                if done == n:
                    yield None

    every = tokens()
    for _ in blobs:
        yield takewhile(lambda part: part is not None, every)


def _listed(parts: Iterable[np.ndarray]) -> list[Token]:
    return [Token(*t) for part in parts for t in part.tolist()]


def parse(data: bytes) -> list[Token]:
    """Greedy parse with hash chains: nearest of the longest matches; covers ``data`` exactly."""
    return next(parse_many([data]))


def parse_table(data: bytes) -> np.ndarray:
    """``parse`` as a table, a row (start, length, offset) for each token: a sixth of the memory."""
    return np.concatenate([np.empty((0, 3), np.int64), *next(parse_parts([data]))])


def listed(tokens: np.ndarray, rows: int = 1 << 16) -> Iterator[Token]:
    """The tokens of a table, some of them at a time."""
    for a in range(0, len(tokens), rows):
        yield from (Token(*t) for t in tokens[a : a + rows].tolist())


def parse_parts(blobs: Sequence[bytes]) -> Iterator[Iterator[np.ndarray]]:
    """``parse`` of each blob, a block at a time; short ones take far less time together."""

    def keys(data: bytes) -> np.ndarray:
        raw = np.frombuffer(data + bytes(3), np.uint8).astype(np.uint32)
        return ((raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16 | raw[3:] << 24) * np.uint32(MULTIPLIER)) >> np.uint32(16)

    return _parts(blobs, keys, WINDOW, MIN_MATCH, MAX_TRIES)


def parse_many(blobs: Sequence[bytes]) -> Iterator[list[Token]]:
    return (_listed(parts) for parts in parse_parts(blobs))


def parse_far(data: bytes, min_match: int = 4, window: int = 4096) -> list[Token]:
    """Greedy parse over all matches in the window: farthest of the longest (at most 258 bytes).

    Any match worth taking shares its first ``min_match`` bytes, so only such positions are compared.
    """
    return next(parse_far_many([data], min_match, window))


def parse_far_parts(blobs: Sequence[bytes], min_match: int = 4, window: int = 4096) -> Iterator[Iterator[np.ndarray]]:
    """``parse_far`` of each blob, a block at a time; short ones take far less time together."""
    shared = max(1, min_match)

    def keys(data: bytes) -> np.ndarray:
        if shared <= 8:
            return _words(data)[: len(data)] & np.uint64((1 << 8 * shared) - 1)
        padded = np.frombuffer(data + bytes(shared - 1), np.uint8)
        windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, shared)) if data else np.zeros((0, shared), np.uint8)
        return np.unique(windows.view(f"V{shared}").ravel(), return_inverse=True)[1]

    return _parts(blobs, keys, window, shared, None)


def parse_far_many(blobs: Sequence[bytes], min_match: int = 4, window: int = 4096) -> Iterator[list[Token]]:
    return (_listed(parts) for parts in parse_far_parts(blobs, min_match, window))


def encode(data: bytes, tokens: Iterable[Token]) -> bytes:
    """The plain program of a parse: LIT and CPY, no HALT."""
    out = bytearray()
    for t in tokens:
        if t.offset:
            out += bytes([CPY]) + leb.encode(t.offset) + leb.encode(t.length)
        else:
            out += bytes([LIT]) + leb.encode(t.length) + data[t.start : t.start + t.length]
    return bytes(out)


def literal(data: bytes) -> bytes:
    """A literal, deflated where that is shorter (never for 32 bytes or less)."""
    plain = bytes([LIT]) + leb.encode(len(data)) + data
    if len(data) <= 32:
        return plain
    packed = zlib.compress(data, 1)
    deflated = bytes([ELIT]) + leb.encode(len(packed)) + leb.encode(len(data)) + packed
    return min(plain, deflated, key=len)


def compress_naive(data: bytes, min_match: int = 4, window: int = 4096, halt: bool = True) -> bytes:
    """Program of the far parse with deflated literals."""
    return _naive_program(data, next(parse_far_parts([data], min_match, window))) + bytes([HALT]) * halt


def compress_naive_many(blobs: Sequence[bytes]) -> Iterator[bytes]:
    return (program + bytes([HALT]) for program in naive_programs(blobs))


def naive_programs(blobs: Sequence[bytes], window: int = 4096) -> Iterator[bytes]:
    """``compress_naive`` of each blob, without HALT."""
    return (_naive_program(d, t) for d, t in zip(blobs, parse_far_parts(blobs, window=window)))


def _naive_program(data: bytes, parts: Iterable[np.ndarray]) -> bytes:
    out = bytearray()
    for part in parts:
        for start, length, offset in part.tolist():
            out += bytes([CPY]) + leb.encode(offset) + leb.encode(length) if offset else literal(data[start : start + length])
    return bytes(out)


def _runs(same: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places from which at least ``least`` units run on, and for how many; ``same[i]``: unit i + 1 goes on from unit i."""
    ends = np.append(np.flatnonzero(~same), len(same))
    lengths = ends[np.searchsorted(ends, np.arange(len(same)))] - np.arange(len(same)) + 1
    places = np.flatnonzero(lengths >= least)
    return places, lengths[places]


def loop_runs(data: bytes) -> list[tuple[int, int, int]]:
    """(start, length, unit) of runs to be made by loops, from the left, none over another.

    Units of four bytes are 32-bit words that rise by one, three or more from an aligned place; units of one are equal
    bytes, 4 to 65,535. Words come first where both begin.
    """
    raw, words = np.frombuffer(data, np.uint8), np.frombuffer(data[: len(data) // 4 * 4], "<u4")
    equal, rising = _runs(raw[1:] == raw[:-1], 4), _runs(words[1:] - words[:-1] == 1, 3)
    found = dict(zip(equal[0].tolist(), ((n, 1) for n in np.minimum(equal[1], 65535).tolist())))
    found.update(zip((4 * rising[0]).tolist(), ((n, 4) for n in (4 * rising[1]).tolist())))
    places, out, k = sorted(found), [], 0
    while k < len(places):
        out.append((places[k], *found[places[k]]))
        k = bisect_left(places, places[k] + out[-1][1], k + 1)
    return out


def compress_smart(data: bytes) -> bytes:
    """Counting runs and runs of one byte as loops, programs of their own for what lies between (found together)."""
    runs = loop_runs(data)
    edges = [0, *(x for start, length, _ in runs for x in (start, start + length)), len(data)]
    between = naive_programs([data[a:b] for a, b in zip(edges[::2], edges[1::2])])
    parts = [next(between)]
    for (at, length, unit), program in zip(runs, between):
        body = bytes([CPY]) + leb.encode(unit) * 2 + (bytes([MAP, 2, 4]) if unit == 4 else b"")
        parts += bytes([LIT, unit]) + data[at : at + unit], bytes([LOOP]) + leb.encode(length // unit - 1) + leb.encode(len(body)) + body, program
    return b"".join(parts) + bytes([HALT])


def coverage(program: bytes) -> list[tuple[int, str]]:
    """(bytes, CPY or LIT) for each instruction of a flat program; deflated literals are LIT."""
    out, at = [], 0
    while at < len(program) and program[at] != HALT:
        it = decode_at(program, at)
        at = it.end
        if it.op == CPY:
            out.append((it.numbers[1], "CPY"))
        elif it.op in (LIT, ELIT):
            out.append((it.numbers[it.op == ELIT], "LIT"))
    return out


def spans(program: bytes) -> list[tuple[int, int, str]]:
    """(start, end, CPY or LIT): what each instruction of a flat program covers."""
    out, at = [], 0
    for length, kind in coverage(program):
        out.append((at, at + length, kind))
        at += length
    return out


def statistics(tokens: Sequence[Token] | np.ndarray, total: int) -> dict[str, float]:
    """Of a list or a table of tokens."""
    _, lengths, offsets = np.asarray(tokens, np.int64).reshape(-1, 3).T
    copied = offsets > 0
    matches, match_bytes = int(copied.sum()), int(lengths[copied].sum())
    return {
        "literal_fraction": (int(lengths.sum()) - match_bytes) / total if total else 1.0,
        "avg_match_len": match_bytes / matches if matches else 0.0,
        "literal_count": len(lengths) - matches,
        "match_count": matches,
    }
