"""Unsigned LEB128 numbers of at most 32 bits."""

from __future__ import annotations

from functools import lru_cache

from .errors import VmError

LIMIT = 1 << 32


@lru_cache(maxsize=1 << 16)
def encode(n: int) -> bytes:
    """The shortest encoding, 1 to 5 bytes."""
    if not 0 <= n < LIMIT:
        raise ValueError(f"{n} is not an unsigned 32-bit number")
    groups = [n >> shift & 0x7F for shift in range(0, max(1, n.bit_length()), 7)]
    return bytes([*(g | 0x80 for g in groups[:-1]), groups[-1]])


def size(n: int) -> int:
    return max(1, -(-n.bit_length() // 7))


def decode(data: bytes, at: int = 0) -> tuple[int, int]:
    """(value, position after it); a number that is cut off or longer than 5 bytes is an error."""
    value = 0
    for k in range(5):
        if at + k >= len(data):
            break
        byte = data[at + k]
        value |= (byte & 0x7F) << 7 * k
        if byte < 0x80:
            return value & (LIMIT - 1), at + k + 1
    raise VmError("TRUNCATED")
