"""In-place transforms of the last bytes of the output, and their inverses where encoders need them."""

from __future__ import annotations

import numpy as np

from .errors import VmError

#: Transform ids.
IDS = {
    "INC_U8": 0,
    "DEC_U8": 1,
    "INC_U32": 2,
    "DEC_U32": 3,
    "DELTA_U8": 4,
    "DELTA_U32": 5,
    "BYTESWAP_U32": 6,
    "ZIGZAG_U32": 7,
}
NAMES = {v: k for k, v in IDS.items()}


def apply(transform: int, data: bytes, single_word: bool = True) -> bytes:
    """The transformed bytes. 32-bit transforms read little-endian words.

    With ``single_word`` all 32-bit transforms but DELTA_U32 take exactly one word; without it, any number.
    """
    name = NAMES.get(transform)
    if name is None:
        raise VmError("UNKNOWN_TRANSFORM")
    if name.endswith("U32"):
        one = single_word and name != "DELTA_U32"
        if len(data) % 4 or (one and len(data) != 4):
            raise VmError("UNKNOWN_TRANSFORM")
        words = np.frombuffer(data, "<u4")
    else:
        words = np.frombuffer(data, np.uint8)
    if name.startswith("INC"):
        out = words + words.dtype.type(1)
    elif name.startswith("DEC"):
        out = words - words.dtype.type(1)
    elif name.startswith("DELTA"):
        out = np.cumsum(words, dtype=words.dtype)
    elif name == "BYTESWAP_U32":
        out = words.byteswap()
    else:
        out = (words >> np.uint32(1)) ^ (np.uint32(0) - (words & np.uint32(1)))
    return out.astype(words.dtype).tobytes()


def delta(data: bytes) -> bytes:
    """What DELTA_U8 turns into ``data``: the first byte, then differences modulo 256."""
    values = np.frombuffer(data, np.uint8)
    return np.diff(values, prepend=np.uint8(0)).astype(np.uint8).tobytes()
