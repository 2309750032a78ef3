"""What a blob looks like: entropy, similarity of lines, text validity, format and class."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

from . import lz

#: First bytes of formats that are compressed already (hexadecimal, at offset 0).
MAGIC = (
    "FFD8FF",  # JPEG
    "89504E470D0A1A0A",  # PNG
    "47494638",  # GIF
    "504B0304",  # ZIP
    "377ABCAF271C",  # 7z
    "526172211A07",  # RAR
    "1F8B",  # gzip
    "425A68",  # bzip2
    "28B52FFD",  # zstd
    "FD377A585A00",  # XZ
    "4D5A",  # PE executable
    "4F676753",  # OGG
    "664C6143",  # FLAC
    "0000002066747970",  # MP4
    "5041434B",  # git pack
)
#: Fixed values: (first bytes, bytes at the offset, offset).
MAGIC_AT = (("52494646", "57454250", 8), ("", "66747970", 4))
#: A format with bytes at an offset needs a blob of at least this length.
MAGIC_LENGTH = 12

CLASSES = ("AlreadyCompressed", "Binary", "JsonArray", "StructuredLog", "UnstructuredText", "SemiStructured")


def is_compressed(data: bytes) -> bool:
    head = data[:MAGIC_LENGTH]
    if head.startswith(tuple(bytes.fromhex(m) for m in MAGIC)):
        return True
    return len(head) == MAGIC_LENGTH and any(
        head.startswith(bytes.fromhex(a)) and head[at:].startswith(bytes.fromhex(b)) for a, b, at in MAGIC_AT
    )


def entropy(data: bytes) -> float:
    """Bits per byte of the byte frequencies; 0 for no bytes."""
    if not data:
        return 0.0
    counts = np.bincount(np.frombuffer(data, np.uint8))
    p = counts[counts > 0] / len(data)
    return float(abs(-(p * np.log2(p)).sum()))


def line_similarity(data: bytes) -> float:
    """Mean Jaccard similarity of the 4-gram sets of neighbouring lines of at least 4 bytes."""
    shares, last = [], None
    for line in _lines(data):
        if len(line) < 4:
            continue
        grams = {line[i : i + 4] for i in range(len(line) - 3)}
        if last is not None:
            shares.append(len(last & grams) / len(last | grams))
        last = grams
    return sum(shares) / len(shares) if shares else 0.0


def _lines(data: bytes) -> Iterator[bytes]:
    """The pieces between newlines, one at a time."""
    at = 0
    while (end := data.find(b"\n", at)) >= 0:
        yield data[at:end]
        at = end + 1
    yield data[at:]


def utf8_valid_ratio(data: bytes) -> float:
    """Share of units that are a lead byte with its continuation bytes.

    A unit that is not is one byte. Only lead and continuation bits are looked at, so surrogates and
    overlong forms of three and four bytes count as valid.
    """
    if not data:
        return 1.0
    try:  # what a strict decoder takes is valid here too
        data.decode()
        return 1.0
    except UnicodeDecodeError:
        pass
    valid = total = at = 0
    n = len(data)
    while at < n:
        lead = data[at]
        length = 1 if lead < 0x80 else 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0
        good = 0 < length <= n - at and all(b & 0xC0 == 0x80 for b in data[at + 1 : at + length])
        valid += good
        total += 1
        at += length if good else 1
    return valid / total


def looks_json(data: bytes) -> bool:
    head = data.lstrip(b" \t\r\n")[:2]
    return head[:1] == b"{" or head == b"[{"


def metrics(data: bytes, tokens: Sequence[lz.Token] | np.ndarray | None = None) -> dict[str, float]:
    """The five numbers classes are decided by."""
    stats = lz.statistics(lz.parse(data) if tokens is None else tokens, len(data))
    return {
        "literal_fraction": stats["literal_fraction"],
        "avg_match_len": stats["avg_match_len"],
        "line_similarity": line_similarity(data),
        "byte_entropy": entropy(data),
        "utf8_valid_ratio": utf8_valid_ratio(data),
    }


def classify(m: dict[str, float], data: bytes | None = None) -> str:
    """The class by ordered rules; without the data it cannot be AlreadyCompressed or JsonArray."""
    rules = (
        ("AlreadyCompressed", data is not None and is_compressed(data)),
        ("Binary", m["byte_entropy"] > 7.5 and m["utf8_valid_ratio"] < 0.70),
        ("JsonArray", data is not None and looks_json(data) and m["utf8_valid_ratio"] > 0.85),
        ("StructuredLog", m["line_similarity"] > 0.60 and m["literal_fraction"] < 0.45),
        ("UnstructuredText", m["literal_fraction"] > 0.65 and m["avg_match_len"] < 10.0),
    )
    return next((name for name, holds in rules if holds), "SemiStructured")
