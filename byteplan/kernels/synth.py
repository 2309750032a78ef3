"""Programs by description length: rows, loops, macros and deltas on the bytes, LZ on the rest.

A program under construction is a list of pieces: literals still open to rewriting, and finished
instructions. A rewrite is taken only if it makes the whole shorter; the best one first, until none is
left. Two ways compete, structure first and LZ first, and every result is run before it is given out.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np

from . import leb, lz, profile, transforms
from .rows import find_rows
from .vm import CALL, LOOP, MAP, REF, run

#: Shortest loop body and fewest turns; macro lengths for hashing and for suffix arrays;
#: fewest uses of a macro; largest literal searched for macros; smallest one for suffix arrays.
MIN_BODY, MIN_TURNS = 4, 3
MACRO_LENGTHS, LONG_LENGTHS, MIN_USES = (8, 64), (65, 1024), 2
MAX_SEARCHED, MIN_SUFFIXED = 16 * 1024, 256


@dataclass(slots=True)
class Piece:
    """A literal (``open``) or an encoded instruction."""

    data: bytes
    open: bool = True

    def code(self) -> bytes:
        return b"\0" + leb.encode(len(self.data)) + self.data if self.open else self.data

    def size(self) -> int:
        return _literal_size(len(self.data)) if self.open else len(self.data)


@dataclass
class Program:
    pieces: list[Piece]
    input_len: int
    macros: dict[int, bytes] = field(default_factory=dict)
    dictionary: dict[bytes, bytes] = field(default_factory=dict)

    def code(self) -> bytes:
        return b"".join(p.code() for p in self.pieces)

    def size(self) -> int:
        """Bytes of the main program and of the macros with four bytes for each one's header."""
        return sum(p.size() for p in self.pieces) + sum(4 + len(m) for m in self.macros.values())

    def ratio(self) -> float:
        return self.size() / self.input_len if self.input_len else 1.0

    def literals(self) -> list[bytes]:
        return [p.data for p in self.pieces if p.open]

    def output(self) -> bytes:
        return run(self.code(), self.macros, self.dictionary)


def _literal_size(n: int) -> int:
    return 1 + leb.size(n) + n


def loop_gain(length: int, period: int, count: int) -> int:
    body = _literal_size(period)
    return _literal_size(length) - (1 + leb.size(count) + leb.size(body) + body)


def macro_gain(length: int, uses: int, macro: int) -> int:
    return uses * (_literal_size(length) - 1 - leb.size(macro)) - 4 - _literal_size(length)


def find_period(data: bytes) -> tuple[int, int] | None:
    """(period, turns) of data that is one body of at least 4 bytes, at least 3 times over."""
    n = len(data)
    for period in range(MIN_BODY, n // MIN_TURNS + 1):
        if n % period == 0 and data[period:] == data[:-period]:
            return period, n // period
    return None


def delta_gain(data: bytes) -> tuple[int, bytes] | None:
    """(bytes saved after entropy coding, differences), if it is worth a MAP instruction."""
    n = len(data)
    if n < 8:
        return None
    changed = transforms.delta(data)
    gain = int((profile.entropy(data) - profile.entropy(changed)) * n / 8.0) - (2 + leb.size(n))
    return (gain, changed) if gain > 0 else None


def repeated_substrings(data: bytes, shortest: int, longest: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """For each length, (overlapping count, first place) of every substring that occurs twice or more.

    A substring repeats only if the one a byte shorter does, so each length looks only at places that are
    left from the one before. Substrings are told apart by 64-bit hashes.
    """
    values = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    at = np.arange(len(data) - shortest + 1)
    keys = np.zeros(max(0, len(at)), np.uint64)
    for i in range(shortest):
        keys = keys * np.uint64(0x100000001B3) + values[i : i + len(at)]
    for length in range(shortest, longest + 1):
        _, first, group, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        repeated = counts >= 2
        if not repeated.any():
            return
        yield length, list(zip(counts[repeated].tolist(), at[first[repeated]].tolist()))
        keep = repeated[group] & (at + length < len(data))
        at, keys = at[keep], keys[keep] * np.uint64(0x100000001B3) + values[at[keep] + length]


def repeats(data: bytes, length: int) -> bool:
    """Whether some substring of this length occurs twice (by 64-bit hashes of doubled length)."""
    if len(data) <= length:
        return False
    base, done = 0x100000001B3, 1
    keys = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    while done * 2 <= length:
        keys = keys[:-done] * np.uint64(pow(base, done, 1 << 64)) + keys[done:]
        done *= 2
    keys = keys[: len(data) - length + 1] * np.uint64(pow(base, length, 1 << 64)) + keys[length - done :]
    keys.sort()
    return bool((keys[1:] == keys[:-1]).any())


def best_macro(data: bytes, macro: int) -> tuple[int, bytes] | None:
    """(gain, pattern) of the best macro of 8 to 64 bytes in one literal; shorter, then more frequent, then earlier first on ties."""
    low, high = MACRO_LENGTHS
    best: tuple[int, bytes] | None = None
    if not MIN_USES * low <= len(data) <= MAX_SEARCHED:
        return None
    for length, found in repeated_substrings(data, low, min(high, len(data) // MIN_USES)):
        for most, first in sorted(found, key=lambda f: (-f[0], f[1])):
            if macro_gain(length, most, macro) <= (best[0] if best else 0):
                break
            pattern = data[first : first + length]
            uses = data.count(pattern)
            gain = macro_gain(length, uses, macro)
            if uses >= MIN_USES and gain > (best[0] if best else 0):
                best = gain, pattern
    return best


def suffix_array(data: bytes) -> np.ndarray:
    """Starts of the suffixes in order, by doubling the compared length."""
    n = len(data)
    rank = np.frombuffer(data, np.uint8).astype(np.int64)
    order, width = np.argsort(rank, kind="stable"), 1
    while n > 1:
        follow = np.concatenate([rank[width:], np.full(min(width, n), -1)])[:n]
        order = np.lexsort((follow, rank))
        step = (rank[order][1:] != rank[order][:-1]) | (follow[order][1:] != follow[order][:-1])
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(step)))
        if rank[order[-1]] == n - 1:
            break
        width *= 2
    return order


def common_prefixes(data: bytes, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it in order (0 for the first)."""
    n = len(data)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    out, length = np.zeros(n, np.int64), 0
    for i, at in enumerate(place.tolist()):
        if at == 0:
            length = 0
            continue
        other = int(order[at - 1])
        while data[i + length : i + length + 1] == data[other + length : other + length + 1] != b"":
            length += 1
        out[at] = length
        length = max(0, length - 1)
    return out


def best_long_macro(data: bytes, macro: int) -> tuple[int, bytes] | None:
    """(gain, pattern) of the best macro of 65 to 1024 bytes among runs of suffixes with long common prefixes."""
    low, high = LONG_LENGTHS
    if not MIN_SUFFIXED <= len(data) <= MAX_SEARCHED or len(data) < low * MIN_USES:
        return None
    if not repeats(data, low):
        return None
    order = suffix_array(data)
    shared = np.minimum(common_prefixes(data, order), high)
    long = np.concatenate(([False], shared >= low, [False]))
    starts, ends = np.flatnonzero(~long[:-1] & long[1:]), np.flatnonzero(long[:-1] & ~long[1:])
    best: tuple[int, bytes] | None = None
    for a, b in zip(starts.tolist(), ends.tolist()):
        length, first = int(shared[a:b].min()), int(order[a - 1])
        pattern = data[first : first + length]
        uses = data.count(pattern)
        gain = macro_gain(length, uses, macro)
        if uses >= MIN_USES and gain > (best[0] if best else 0):
            best = gain, pattern
    return best


@dataclass(frozen=True)
class Synthesizer:
    """Which rewrites are tried."""

    loops: bool = True
    macros: bool = True
    maps: bool = True
    rows: bool = True

    def structure(self, data: bytes) -> Program:
        """Rows, then loops and macros, then deltas, on the bytes themselves."""
        program, rest = Program([], len(data)), data
        while self.rows and rest:
            found = find_rows(rest, len(program.macros))
            if not found:
                break
            if found.prefix:
                program.pieces.append(Piece(found.prefix))
            macro = len(program.macros)
            program.macros[macro] = found.template
            program.pieces.append(Piece(found.code(macro), open=False))
            rest = found.suffix
        if rest:
            program.pieces.append(Piece(rest))
        self.rewrite(program)
        return program

    def rewrite(self, program: Program) -> None:
        known: dict[tuple[bytes, int], list[tuple[int, str, object]]] = {}
        while True:
            macro = len(program.macros)
            best: tuple[int, str, object, int] | None = None
            for k, piece in enumerate(program.pieces):
                if not piece.open or len(piece.data) < MIN_BODY * MIN_TURNS:
                    continue  # too short for a loop, and for a macro
                key = piece.data, leb.size(macro)
                if key not in known:
                    known[key] = self._options(piece.data, macro)
                for gain, kind, what in known[key]:
                    if gain > (best[0] if best else 0):
                        best = gain, kind, what, k
            if best is None:
                break
            _, kind, what, k = best
            if kind == "loop":
                period, count = what
                body = Piece(program.pieces[k].data[:period]).code()
                program.pieces[k] = Piece(bytes([LOOP]) + leb.encode(count) + leb.encode(len(body)) + body, open=False)
            else:
                program.macros[macro] = Piece(what).code()
                call = bytes([CALL]) + leb.encode(macro)
                program.pieces = [q for p in program.pieces for q in (_replace(p.data, {what: call}) if p.open and what in p.data else [p])]
        if self.maps:
            program.pieces = [q for p in program.pieces for q in self._delta(p)]

    def _options(self, data: bytes, macro: int) -> list[tuple[int, str, object]]:
        out: list[tuple[int, str, object]] = []
        if self.loops and (found := find_period(data)):
            out.append((loop_gain(len(data), *found), "loop", found))
        if self.macros:
            for search in (best_macro, best_long_macro):
                if found := search(data, macro):
                    out.append((found[0], "macro", found[1]))
        return out

    def _delta(self, piece: Piece) -> list[Piece]:
        found = delta_gain(piece.data) if piece.open else None
        if not found:
            return [piece]
        code = bytes([MAP, transforms.IDS["DELTA_U8"]]) + leb.encode(len(piece.data))
        return [Piece(found[1]), Piece(code, open=False)]

    def structure_first(self, data: bytes) -> Program:
        """``structure``, then an LZ parse of each literal that is left, on its own."""
        program = self.structure(data)
        program.pieces = [q for p in program.pieces for q in (lz_pieces(p.data) if p.open else [p])]
        return program

    def lz_first(self, data: bytes, tokens: Iterable[lz.Token] | None = None) -> Program:
        program = Program(lz_pieces(data, tokens), len(data))
        self.rewrite(program)
        return program


def lz_pieces(data: bytes, tokens: Iterable[lz.Token] | None = None) -> list[Piece]:
    return [
        Piece(lz.encode(data, [t]), open=False) if t.offset else Piece(data[t.start : t.start + t.length])
        for t in (lz.listed(lz.parse_table(data)) if tokens is None else tokens)
    ]


def lz_size(tokens: Iterable[lz.Token]) -> int:
    """Size of the plain program of a parse."""
    return sum(1 + leb.size(t.offset) + leb.size(t.length) if t.offset else _literal_size(t.length) for t in tokens)


def _replace(data: bytes, codes: Mapping[bytes, bytes]) -> list[Piece]:
    """Literals and instructions: from the left, the longest pattern at each place is replaced by its code."""
    pattern = re.compile(b"|".join(re.escape(p) for p in sorted(codes, key=lambda p: (-len(p), p))), re.S)
    out, at = [], 0
    for found in pattern.finditer(data):
        if at < found.start():
            out.append(Piece(data[at : found.start()]))
        out.append(Piece(codes[found[0]], open=False))
        at = found.end()
    return [*out, Piece(data[at:])] if at < len(data) else out


def apply_dictionary(program: Program, dictionary: Mapping[bytes, bytes]) -> None:
    """Replace dictionary patterns in literals by references, where those are shorter; keep what is used."""
    keys: dict[bytes, bytes] = {}
    for key in sorted(dictionary, reverse=True):
        if len(dictionary[key]) > 2 + len(key):
            keys[dictionary[key]] = key
    if keys:
        codes = {p: bytes([REF, len(k)]) + k for p, k in keys.items()}
        program.pieces = [q for p in program.pieces for q in (_replace(p.data, codes) if p.open else [p])]
        used = {p.data for p in program.pieces if not p.open}
        program.dictionary = {k: p for p, k in keys.items() if codes[p] in used}


#: Which rewrites each class gets; None: plain LZ.
SYNTHESIZERS: dict[str, Synthesizer | None] = {
    "StructuredLog": Synthesizer(),
    "JsonArray": Synthesizer(),
    "SemiStructured": Synthesizer(),
    "UnstructuredText": Synthesizer(loops=False, macros=False, rows=False),
    "Binary": None,
    "AlreadyCompressed": None,
}


@dataclass
class Result:
    program: Program
    data_class: str
    metrics: dict[str, float]
    lz_ratio: float
    structure_first: bool

    @property
    def gain(self) -> float:
        return self.lz_ratio - self.program.ratio()


def compress(data: bytes, mode: str = "best") -> Result:
    """Classify, build the program by the class's rewrites, keep the shorter of both ways, run it.

    ``mode`` "lz" tries the LZ-first way only. A program that does not reproduce the data gives way to the
    plain LZ program.
    """
    table = lz.parse_table(data)
    numbers = profile.metrics(data, table)
    name = profile.classify(numbers, data)
    ratio = lz_size(lz.listed(table)) / len(data) if data else 1.0
    plain = lambda: Program(lz_pieces(data, lz.listed(table)), len(data))
    synthesizer, first = SYNTHESIZERS[name], False
    if not synthesizer:
        return Result(plain(), name, numbers, ratio, first)
    program = None
    if mode == "best":  # the one of few pieces first; the longer one goes at once
        program, first = synthesizer.structure_first(data), True
    other = synthesizer.lz_first(data, lz.listed(table))
    if program is None or other.size() < program.size():
        program, first = other, False
    del other
    if program.output() != data:
        program, first = plain(), False
    return Result(program, name, numbers, ratio, first)
