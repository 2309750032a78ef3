"""Row structure inside a blob: delimited and JSON lines, and the templates that reproduce them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from itertools import groupby, islice

from . import leb
from .vm import LIT, NEXT, SCAN

#: Fixed value: fewest rows of a template.
MIN_ROWS = 10
#: Delimiters in the order they are tried.
DELIMITERS = (b",", b"\t", b"|")


@dataclass(frozen=True)
class Scan:
    """``data`` is prefix + ``count`` rows made by ``template`` from ``params`` + suffix."""

    prefix: bytes
    count: int
    template: bytes
    params: tuple[bytes, ...]
    suffix: bytes

    def code(self, macro: int) -> bytes:
        stream = bytearray()
        for p in self.params:
            stream += leb.encode(len(p)) + p
        return bytes([SCAN]) + leb.encode(self.count) + leb.encode(macro) + leb.encode(len(stream)) + bytes(stream)


def _lit(data: bytes) -> bytes:
    return bytes([LIT]) + leb.encode(len(data)) + data


def split_lines(data: bytes) -> list[bytes]:
    """Lines with their newlines; only the last may lack one."""
    return re.findall(rb"[^\n]*\n|[^\n]+", data)


def count_delimiters(line: bytes, delimiter: bytes) -> int:
    """Delimiters outside double quotes; a doubled quote inside quotes changes nothing."""
    return sum(part.count(delimiter) for part in line.split(b'"')[::2])


def split_fields(line: bytes, delimiter: bytes) -> list[bytes]:
    """Fields with their quotes as they stand."""
    out, field = [], b""
    for k, part in enumerate(line.split(b'"')):
        if k:
            field += b'"'
        if k % 2:  # between quotes
            field += part
            continue
        first, *more = part.split(delimiter)
        field += first
        for piece in more:
            out.append(field)
            field = piece
    return [*out, field]


def longest_run(keys: list) -> tuple[int, int, object]:
    """(start, length, key) of the longest run of equal keys that are not None; the first of equals."""
    best, at = (0, 0, None), 0
    for key, group in groupby(keys):
        length = sum(1 for _ in group)
        if key is not None and length > best[1]:
            best = at, length, key
        at += length
    return best


def _template(lines: list[bytes], start: int, length: int, rows: Callable[[], Iterable[list[bytes]]], separators: list[bytes], macro: int) -> Scan | None:
    """The scan of rows of fields between fixed separators, if it is shorter than the bytes themselves.

    ``rows`` gives the rows anew each time, so that they need not be held.
    """
    first = next(iter(rows()))
    fixed = [True] * len(first)
    for row in rows():
        if row != first:
            fixed = [same and value == kept for same, value, kept in zip(fixed, row, first)]
    if all(fixed):
        return None
    template = b""
    for separator, value, same in zip(separators, first, fixed):
        template += (_lit(separator) if separator else b"") + (_lit(value) if same else bytes([NEXT]))
    template += _lit(separators[-1])
    params = tuple(value for row in rows() for value, same in zip(row, fixed) if not same)
    end = start + length
    block = sum(map(len, lines[start:end]))
    scan = Scan(b"".join(lines[:start]), length, template, params, b"".join(lines[end:]))
    worth = 4 + len(template) + len(scan.code(macro)) < 1 + leb.size(block) + block
    return scan if worth else None


def find_delimited(data: bytes, delimiter: bytes, macro: int = 0) -> Scan | None:
    """Template of the longest run of terminated lines with one number of delimiters (at least one)."""
    lines = split_lines(data)
    counts = [count_delimiters(line, delimiter) if line.endswith(b"\n") else None for line in lines]
    start, length, count = longest_run(counts)
    if length < MIN_ROWS or not count:
        return None
    rows = lambda: (split_fields(line[:-1], delimiter) for line in islice(lines, start, start + length))
    if any(len(r) != count + 1 for r in rows()):
        return None
    return _template(lines, start, length, rows, [b"", *[delimiter] * count, b"\n"], macro)


_SPACE = rb"[ \t\r\n]*"
_STRING = rb'"(?:[^"\\]|\\.)*"'
_TOKEN = re.compile(rb"true|false|null|[-0-9][^,}\] \t\r\n]*", re.S)
_STRING_AT = re.compile(_STRING, re.S)
_BRACKETS = re.compile(rb'"(?:[^"\\]|\\.)*"|[\[\]{}]', re.S)
_WRAPPED = re.compile(rb"([ \t\r\n\[,]*)(\{.*\})([ \t\r\n\],]*)", re.S)


def json_string_end(data: bytes, at: int) -> int | None:
    found = _STRING_AT.match(data, at)
    return found.end() if found else None


def json_value_end(data: bytes, at: int) -> int | None:
    """Where the value that starts at ``at`` ends; nested values are skipped whole."""
    first = data[at : at + 1]
    if first == b'"':
        return json_string_end(data, at)
    if first not in (b"[", b"{") or not first:
        found = _TOKEN.match(data, at)
        return found.end() if found else None
    close, depth = {b"[": b"]", b"{": b"}"}[first], 0
    for found in _BRACKETS.finditer(data, at):
        depth += (found[0] == first) - (found[0] == close)
        if depth == 0:
            return found.end()
    return None


_KEY = re.compile(_SPACE + rb"(" + _STRING + rb")[ \t]*:[ \t]*", re.S)
_AFTER = re.compile(_SPACE + rb"([,}])")


def json_members(data: bytes) -> list[tuple[bytes, int, int]] | None:
    """(quoted key, start, end of its value) for each member of the object; None if it is not a plain one."""
    head = re.match(_SPACE + rb"\{", data)
    out: list[tuple[bytes, int, int]] = []
    at = head.end() if head else -1
    while at >= 0:
        key = _KEY.match(data, at)
        if not key:
            return None
        end = json_value_end(data, key.end())
        after = _AFTER.match(data, end) if end is not None else None
        if not after:
            return None
        out.append((key[1], key.end(), end))
        if after[1] == b"}":
            return out
        at = after.end()
        if re.compile(_SPACE + rb"\}").match(data, at):
            return out
    return None


def json_object(line: bytes) -> bytes | None:
    """The object in a line of NDJSON or of a JSON array with one object per line."""
    found = _WRAPPED.fullmatch(line)
    return found[2] if found else None


def _json_row(line: bytes) -> tuple[tuple[bytes, ...], list[bytes]] | None:
    """(separators, values): the line is separators[0] + values[0] + separators[1] + ... + separators[-1].

    Everything outside the values is separator, with whatever wraps the object, so lines that are put together again are
    the lines that were taken apart.
    """
    found = _WRAPPED.fullmatch(line)
    members = json_members(found[2]) if found else None
    if not members:
        return None
    shift, cuts = found.start(2), [0]
    for _, a, b in members:
        cuts += [shift + a, shift + b]
    cuts.append(len(line))
    parts = [line[a:b] for a, b in zip(cuts, cuts[1:])]
    return tuple(parts[::2]), parts[1::2]


def find_json(data: bytes, macro: int = 0) -> Scan | None:
    """Template of the longest run of lines that are JSON objects with the same keys, spacing and wrapping."""
    lines = split_lines(data)
    parsed = [_json_row(line) for line in lines]
    start, length, separators = longest_run([p and p[0] for p in parsed])
    if length < MIN_ROWS:
        return None
    return _template(lines, start, length, lambda: (p[1] for p in islice(parsed, start, start + length)), list(separators), macro)


def find_rows(data: bytes, macro: int = 0) -> Scan | None:
    """JSON first where the data looks like it, then the delimiters in order."""
    from .profile import looks_json

    found = find_json(data, macro) if looks_json(data) else None
    for delimiter in DELIMITERS:
        found = found or find_delimited(data, delimiter, macro)
    return found
