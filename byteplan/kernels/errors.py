"""What can go wrong when programs run and containers are read."""

from __future__ import annotations

#: Error codes of the instruction set.
CODES = {
    "UNKNOWN_OPCODE": 0x01,
    "CPY_UNDERFLOW": 0x02,
    "LOOP_OVERRUN": 0x03,
    "OUTPUT_OVERFLOW": 0x04,
    "CALL_DEPTH": 0x05,
    "CALL_CYCLE": 0x06,
    "UNKNOWN_REF": 0x07,
    "HASH_MISMATCH": 0x08,
    "DICTIONARY_UNAVAILABLE": 0x09,
    "UNKNOWN_TRANSFORM": 0x0A,
    "NEXT_OUTSIDE_SCAN": 0x0B,
    "PARAMS_EXHAUSTED": 0x0C,
    "TRUNCATED": 0xFF,
}


class VmError(Exception):
    """A program that cannot run; ``name`` is a key of CODES."""

    def __init__(self, name: str) -> None:
        super().__init__(f"{name} (0x{CODES[name]:02X})")
        self.name, self.code = name, CODES[name]

    def __reduce__(self):
        return VmError, (self.name,)


class FormatError(ValueError):
    """A container that cannot be read: TOO_SHORT, BAD_MAGIC, BAD_VERSION, BAD_PAYLOAD, LENGTH_MISMATCH, COUNT_MISMATCH, HASH_MISMATCH, BAD_METHOD, BAD_PATH."""

    def __init__(self, name: str, detail: str = "") -> None:
        super().__init__(f"{name} {detail}".strip())
        self.name = name
