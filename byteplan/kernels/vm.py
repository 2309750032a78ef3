"""The virtual machine that runs reconstruction programs, and helpers to write and read them.

The machine keeps its own stack of frames, one for each program, loop body, macro or template that is
being run, so nesting is bounded by the machine's rules and not by Python's stack.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

from . import leb, transforms
from .errors import VmError

#: Instruction codes.
LIT, CPY, MAP, LOOP, CALL, REF, ELIT, SCAN, NEXT, HALT = 0, 1, 2, 3, 4, 5, 6, 7, 8, 0xFF
NAMES = {0: "LIT", 1: "CPY", 2: "MAP", 3: "LOOP", 4: "CALL", 5: "REF", 6: "ELIT", 7: "SCAN", 8: "NEXT", 0xFF: "HALT"}
#: Deepest nesting of CALL and SCAN, and the default limit of the output.
MAX_DEPTH, MAX_OUTPUT = 16, 256 * 1024 * 1024


@dataclass
class Instruction:
    """One decoded instruction; ``start`` and ``end`` are its place in the program."""

    op: int
    start: int
    end: int
    numbers: tuple[int, ...] = ()
    data: bytes = b""

    @property
    def name(self) -> str:
        return NAMES[self.op]


def decode_at(program: bytes, at: int) -> Instruction:
    op, start, numbers, data = program[at], at, [], b""
    at += 1
    if op not in NAMES:
        raise VmError("UNKNOWN_OPCODE")
    if op == MAP:
        if at >= len(program):
            raise VmError("TRUNCATED")
        numbers.append(program[at])
        at += 1
    for _ in range({LIT: 1, CPY: 2, MAP: 1, LOOP: 2, CALL: 1, ELIT: 2, SCAN: 3}.get(op, 0)):
        value, at = leb.decode(program, at)
        numbers.append(value)
    if op == REF:
        if at >= len(program):
            raise VmError("TRUNCATED")
        numbers.append(program[at])
        at += 1
    follows = {LIT: 0, LOOP: 1, REF: 0, ELIT: 0, SCAN: 2}.get(op)
    if follows is not None:
        length = numbers[follows]
        if at + length > len(program):
            raise VmError("LOOP_OVERRUN" if op == LOOP else "TRUNCATED")
        data = program[at : at + length]
        at += length
    return Instruction(op, start, at, tuple(numbers), data)


def instructions(program: bytes) -> Iterator[Instruction]:
    """The instructions of one frame, up to HALT or the end; loop bodies are not entered."""
    at = 0
    while at < len(program):
        found = decode_at(program, at)
        yield found
        if found.op == HALT:
            return
        at = found.end


class _Frame:
    __slots__ = ("code", "at", "left", "macro", "params")

    def __init__(self, code: bytes, left: int = 1, macro: int | None = None, params: list | None = None) -> None:
        self.code, self.at, self.left, self.macro, self.params = code, 0, left, macro, params


def run(
    program: bytes,
    macros: Mapping[int, bytes] | None = None,
    dictionary: Mapping[bytes, bytes] | None = None,
    max_output: int = MAX_OUTPUT,
    strict_halt: bool = False,
) -> bytes:
    """The bytes the program produces.

    HALT ends the iteration of the frame it stands in. With ``strict_halt`` a main program that ends
    without HALT is truncated; by default both are accepted.
    """
    macros, dictionary = macros or {}, dictionary or {}
    out, stack, depth = bytearray(), [_Frame(program)], 0
    active: list[int] = []
    halted = False

    def emit(data: bytes) -> None:
        if len(out) + len(data) > max_output:
            raise VmError("OUTPUT_OVERFLOW")
        out.extend(data)

    while stack:
        frame = stack[-1]
        if frame.left <= 0 or frame.at >= len(frame.code):
            frame.left, frame.at = frame.left - 1, 0
            if frame.left <= 0 or not frame.code:
                stack.pop()
                if frame.macro is not None:
                    active.pop()
                depth -= frame.macro is not None or frame.params is not None
            continue
        it = decode_at(frame.code, frame.at)
        frame.at = it.end
        op = it.op
        if op == LIT:
            emit(it.data)
        elif op == CPY:
            offset, length = it.numbers
            if not 0 < offset <= len(out):
                raise VmError("CPY_UNDERFLOW")
            source = bytes(out[len(out) - offset : len(out) - offset + min(length, offset)])
            if len(out) + length > max_output:
                raise VmError("OUTPUT_OVERFLOW")
            emit((source * (length // offset + 1))[:length])
        elif op == MAP:
            transform, length = it.numbers
            if transform not in transforms.NAMES:
                raise VmError("UNKNOWN_TRANSFORM")
            if length > len(out):
                raise VmError("CPY_UNDERFLOW")
            start = len(out) - length
            out[start:] = transforms.apply(transform, bytes(out[start:]))
        elif op == LOOP:
            stack.append(_Frame(it.data, left=it.numbers[0]))
        elif op == CALL:
            macro = it.numbers[0]
            if depth >= MAX_DEPTH:
                raise VmError("CALL_DEPTH")
            if macro in active:
                raise VmError("CALL_CYCLE")
            if macro not in macros:
                raise VmError("UNKNOWN_REF")
            stack.append(_Frame(macros[macro], macro=macro))
            active.append(macro)
            depth += 1
        elif op == REF:
            if it.data not in dictionary:
                raise VmError("UNKNOWN_REF")
            emit(dictionary[it.data])
        elif op == ELIT:
            try:
                emit(zlib.decompress(it.data))
            except zlib.error:
                raise VmError("TRUNCATED") from None
        elif op == SCAN:
            count, template, _ = it.numbers
            if depth >= MAX_DEPTH:
                raise VmError("CALL_DEPTH")
            if template not in macros:
                raise VmError("UNKNOWN_REF")
            stack.append(_Frame(macros[template], left=count, params=[it.data, 0]))
            depth += 1
        elif op == NEXT:
            params = next((f.params for f in reversed(stack) if f.params is not None), None)
            if params is None:
                raise VmError("NEXT_OUTSIDE_SCAN")
            stream, at = params
            if at >= len(stream):
                raise VmError("PARAMS_EXHAUSTED")
            length, at = leb.decode(stream, at)
            if at + length > len(stream):
                raise VmError("TRUNCATED")
            emit(stream[at : at + length])
            params[1] = at + length
        else:  # HALT
            frame.at = len(frame.code)
            halted |= len(stack) == 1
    if strict_halt and not halted:
        raise VmError("TRUNCATED")
    return bytes(out)


def validate(program: bytes, macros: Mapping[int, bytes] | None = None) -> int:
    """0, or the code of the first static fault: opcodes, transforms, lengths, unknown or cyclic macros."""
    macros = macros or {}
    done: set[int] = set()

    def walk(code: bytes, path: tuple[int, ...]) -> None:
        for it in instructions(code):
            if it.op == MAP and it.numbers[0] not in transforms.NAMES:
                raise VmError("UNKNOWN_TRANSFORM")
            if it.op == LOOP:
                walk(it.data, path)
            if it.op in (CALL, SCAN):
                macro = it.numbers[0] if it.op == CALL else it.numbers[1]
                if macro not in macros:
                    raise VmError("UNKNOWN_REF")
                if macro in path:
                    raise VmError("CALL_CYCLE")
                if len(path) >= MAX_DEPTH:
                    raise VmError("CALL_DEPTH")
                if macro not in done:
                    walk(macros[macro], (*path, macro))
                    done.add(macro)

    try:
        walk(program, ())
    except VmError as e:
        return e.code
    return 0


@dataclass
class ProgramBuilder:
    """Write a program step by step; every method returns the builder."""

    code: bytearray = field(default_factory=bytearray)
    macros: dict[int, bytes] = field(default_factory=dict)

    def _put(self, op: int, *numbers: int, data: bytes = b"") -> ProgramBuilder:
        self.code.append(op)
        for n in numbers:
            self.code += leb.encode(n)
        self.code += data
        return self

    def lit(self, data: bytes) -> ProgramBuilder:
        return self._put(LIT, len(data), data=data)

    def cpy(self, offset: int, length: int) -> ProgramBuilder:
        return self._put(CPY, offset, length)

    def map(self, transform: str | int, length: int) -> ProgramBuilder:
        self.code += bytes([MAP, transforms.IDS.get(transform, transform)])
        self.code += leb.encode(length)
        return self

    def loop(self, count: int, body: bytes | ProgramBuilder) -> ProgramBuilder:
        code = bytes(body.code) if isinstance(body, ProgramBuilder) else body
        return self._put(LOOP, count, len(code), data=code)

    def call(self, macro: int) -> ProgramBuilder:
        return self._put(CALL, macro)

    def ref(self, key: bytes) -> ProgramBuilder:
        self.code += bytes([REF, len(key)]) + key
        return self

    def elit(self, data: bytes, level: int = -1) -> ProgramBuilder:
        packed = zlib.compress(data, level)
        return self._put(ELIT, len(packed), len(data), data=packed)

    def scan(self, count: int, template: int, params: list[bytes]) -> ProgramBuilder:
        stream = b"".join(leb.encode(len(p)) + p for p in params)
        return self._put(SCAN, count, template, len(stream), data=stream)

    def next(self) -> ProgramBuilder:
        return self._put(NEXT)

    def halt(self) -> ProgramBuilder:
        return self._put(HALT)

    def add_macro(self, macro: int, body: bytes | ProgramBuilder) -> ProgramBuilder:
        self.macros[macro] = bytes(body.code) if isinstance(body, ProgramBuilder) else body
        return self

    def build(self) -> bytes:
        return bytes(self.code)
