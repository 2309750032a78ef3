"""The binary containers: program files, dictionary snapshots, single blobs and archives of many."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field

from . import leb, synth
from .errors import FormatError, VmError
from .profile import entropy, is_compressed
from .vm import run

#: First bytes and versions of the formats.
PROGRAM_MAGIC, SNAPSHOT_MAGIC, BLOB_MAGIC, ARCHIVE_MAGIC = b"UFI\x01", b"UFC\x01", b"MCAS", b"MCAR"
VERSION = 1
#: Flags of program files, and the flag "has a dictionary" of blobs and archives.
ZLIB, INLINE, MACROS, EXTERNAL, HAS_DICTIONARY = 1, 2, 4, 8, 1
#: Methods of archive entries.
METHODS = {"store": 0, "zlib": 1, "program": 2}
METHOD_NAMES = {v: k for k, v in METHODS.items()}
#: Blobs below are only deflated; blobs above are stored; entropy above is stored.
SMALL, MAX_MEMORY, MAX_ENTROPY = 64 * 1024, 256 * 1024 * 1024, 7.5


class Reader:
    """Sequential reads that fail with one error."""

    def __init__(self, data: bytes, at: int = 0, error: str = "BAD_PAYLOAD") -> None:
        self.data, self.at, self.error = data, at, error

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise FormatError(self.error)
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, fmt: str) -> int:
        return struct.unpack("<" + fmt, self.take(struct.calcsize("<" + fmt)))[0]

    def leb(self) -> int:
        try:
            value, self.at = leb.decode(self.data, self.at)
        except VmError:
            raise FormatError(self.error) from None
        return value


def inflate(data: bytes) -> bytes:
    try:
        return zlib.decompress(data)
    except zlib.error:
        raise FormatError("BAD_PAYLOAD") from None


@dataclass
class Snapshot:
    """A published dictionary: numbered patterns, addressed by a hash of its content."""

    patterns: dict[int, bytes]
    domain: str = "default"
    version: tuple[int, int] = (1, 0)

    @property
    def hash(self) -> bytes:
        body = b"".join(struct.pack("<II", k, len(self.patterns[k])) + self.patterns[k] for k in sorted(self.patterns))
        return hashlib.sha256(body).digest()

    def pattern_hash(self, number: int) -> bytes:
        return hashlib.sha256(self.patterns[number]).digest()

    def statistics(self) -> dict[str, float]:
        joined = b"".join(self.patterns.values())
        return {"n": len(self.patterns), "avg_len": len(joined) / max(1, len(self.patterns)), "h_pattern": entropy(joined)}

    def keyed(self) -> dict[bytes, bytes]:
        """The dictionary by the keys that references carry."""
        return {leb.encode(k): p for k, p in self.patterns.items()}

    def merged(self, delta: Mapping[int, bytes], version: tuple[int, int] | None = None) -> Snapshot:
        """A later snapshot: this one's patterns with some added or replaced."""
        return Snapshot({**self.patterns, **delta}, self.domain, version or (self.version[0], self.version[1] + 1))

    def encode(self) -> bytes:
        domain = self.domain.encode()
        out = SNAPSHOT_MAGIC + bytes([*self.version, 0]) + leb.encode(len(domain)) + domain + leb.encode(len(self.patterns))
        for k in sorted(self.patterns):
            out += leb.encode(k) + leb.encode(len(self.patterns[k])) + self.patterns[k]
        return out + self.hash

    @classmethod
    def decode(cls, data: bytes) -> Snapshot:
        if data[:4] != SNAPSHOT_MAGIC:
            raise FormatError("BAD_MAGIC")
        r = Reader(data, 4)
        major, minor, _ = r.take(3)
        domain = r.take(r.leb()).decode()
        patterns = {}
        for _ in range(r.leb()):
            number = r.leb()
            patterns[number] = r.take(r.leb())
        out = cls(patterns, domain, (major, minor))
        if r.take(32) != out.hash:
            raise FormatError("HASH_MISMATCH")
        return out


@dataclass
class ProgramFile:
    """A program with its macros and its dictionary: inline, external (a snapshot's hash), or both."""

    program: bytes
    macros: dict[int, bytes] = field(default_factory=dict)
    dictionary: dict[bytes, bytes] = field(default_factory=dict)
    snapshot: bytes | None = None
    urls: list[str] = field(default_factory=list)
    deflate: bool = False

    @property
    def source(self) -> str:
        return "EMBEDDED" if self.snapshot is None else "HYBRID" if self.dictionary else "EXTERNAL"

    def encode(self) -> bytes:
        if self.snapshot is not None and len(self.snapshot) != 32:
            raise FormatError("BAD_PAYLOAD", "a snapshot hash has 32 bytes")
        flags = ZLIB * self.deflate | INLINE * bool(self.dictionary) | MACROS * bool(self.macros) | EXTERNAL * (self.snapshot is not None)
        sized = lambda data: leb.encode(len(data)) + data
        out = PROGRAM_MAGIC + bytes([flags]) + leb.encode(VERSION)
        if self.dictionary:
            out += leb.encode(len(self.dictionary)) + b"".join(bytes([len(k)]) + k + sized(p) for k, p in self.dictionary.items())
        if self.macros:
            out += leb.encode(len(self.macros)) + b"".join(leb.encode(k) + sized(b) for k, b in self.macros.items())
        if self.snapshot is not None:
            out += self.snapshot + leb.encode(len(self.urls)) + b"".join(sized(u.encode()) for u in self.urls)
        return out + sized(zlib.compress(self.program, 1) if self.deflate else self.program)

    @classmethod
    def decode(cls, data: bytes) -> ProgramFile:
        if data[:4] != PROGRAM_MAGIC:
            raise FormatError("BAD_MAGIC")
        r = Reader(data, 4)
        flags = r.number("B")
        if r.leb() != VERSION:
            raise FormatError("BAD_VERSION")
        dictionary, macros, snapshot, urls = {}, {}, None, []
        for _ in range(r.leb() if flags & INLINE else 0):
            key = r.take(r.number("B"))
            dictionary[key] = r.take(r.leb())
        for _ in range(r.leb() if flags & MACROS else 0):
            number = r.leb()
            macros[number] = r.take(r.leb())
        if flags & EXTERNAL:
            snapshot = r.take(32)
            urls = [r.take(r.leb()).decode() for _ in range(r.leb())]
        program = r.take(r.leb())
        return cls(inflate(program) if flags & ZLIB else program, macros, dictionary, snapshot, urls, bool(flags & ZLIB))

    def execute(self, snapshot: Snapshot | None = None, external_wins: bool = False) -> bytes:
        """Run it. Inline patterns shadow external ones unless ``external_wins``; the snapshot must be the one named."""
        external: dict[bytes, bytes] = {}
        if self.snapshot is not None:
            if snapshot is None:
                raise VmError("DICTIONARY_UNAVAILABLE")
            if snapshot.hash != self.snapshot:
                raise VmError("HASH_MISMATCH")
            external = snapshot.keyed()
        merged = {**self.dictionary, **external} if external_wins else {**external, **self.dictionary}
        return run(self.program, self.macros, merged)


def _dictionary_section(dictionary: Mapping[bytes, bytes]) -> bytes:
    return struct.pack("<I", len(dictionary)) + b"".join(
        bytes([len(k)]) + k + struct.pack("<I", len(dictionary[k])) + dictionary[k] for k in sorted(dictionary)
    )


def _read_dictionary(r: Reader) -> dict[bytes, bytes]:
    out = {}
    for _ in range(r.number("I")):
        key = r.take(r.number("B"))
        out[key] = r.take(r.number("I"))
    return out


@dataclass
class BlobFile:
    """One blob as a deflated program with macros and, optionally, its dictionary."""

    program: bytes
    macros: dict[int, bytes] = field(default_factory=dict)
    dictionary: dict[bytes, bytes] = field(default_factory=dict)

    def encode(self) -> bytes:
        payload = _dictionary_section(self.dictionary) if self.dictionary else b""
        payload += struct.pack("<I", len(self.macros))
        for k in sorted(self.macros):
            payload += struct.pack("<II", k, len(self.macros[k])) + self.macros[k]
        payload += self.program
        flags = HAS_DICTIONARY if self.dictionary else 0
        return BLOB_MAGIC + bytes([VERSION, flags]) + struct.pack("<I", len(payload)) + zlib.compress(payload, 9)

    @classmethod
    def decode(cls, data: bytes) -> BlobFile:
        if len(data) < 10:
            raise FormatError("TOO_SHORT")
        if data[:4] != BLOB_MAGIC:
            raise FormatError("BAD_MAGIC")
        if data[4] != VERSION:
            raise FormatError("BAD_VERSION")
        payload = inflate(data[10:])
        if len(payload) != struct.unpack_from("<I", data, 6)[0]:
            raise FormatError("LENGTH_MISMATCH")
        r = Reader(payload)
        dictionary = _read_dictionary(r) if data[5] & HAS_DICTIONARY else {}
        macros = {}
        for _ in range(r.number("I")):
            number = r.number("I")
            macros[number] = r.take(r.number("I"))
        return cls(payload[r.at :], macros, dictionary)

    def ratio(self) -> float:
        raw = len(self.program) + sum(map(len, self.macros.values()))
        return len(self.encode()) / raw if raw else 1.0

    def output(self, dictionary: Mapping[bytes, bytes] | None = None) -> bytes:
        """Its own dictionary comes before the archive's."""
        return run(self.program, self.macros, self.dictionary or dictionary)


def encode_blob(data: bytes) -> bytes:
    program = synth.compress(data).program
    return BlobFile(program.code(), program.macros, program.dictionary).encode()


def decode_blob(data: bytes) -> bytes:
    return BlobFile.decode(data).output()


def encode_entry(data: bytes, dictionary: Mapping[bytes, bytes] | None = None, max_memory: int = MAX_MEMORY, force_programs: bool = False) -> tuple[str, bytes]:
    """(method, payload): the shortest of program, deflate and the bytes themselves.

    Compressed, too large or too random blobs are stored; small ones are only deflated unless there is
    a dictionary or ``force_programs``; so is prose. Programs are kept only if they reproduce the blob.
    """
    if is_compressed(data) or len(data) > max_memory or entropy(data) > MAX_ENTROPY:
        return "store", data
    options = [("zlib", zlib.compress(data, 9))]
    if len(data) >= SMALL or dictionary or force_programs:
        found = synth.compress(data)
        if found.data_class in ("AlreadyCompressed", "Binary"):
            return "store", data
        if found.data_class != "UnstructuredText":
            if dictionary:
                synth.apply_dictionary(found.program, dictionary)
            blob = BlobFile(found.program.code(), found.program.macros)
            if blob.output(dictionary) == data:
                options.insert(0, ("program", blob.encode()))
    method, payload = min(options, key=lambda o: len(o[1]))
    return (method, payload) if len(payload) < len(data) else ("store", data)


def decode_entry(method: str, payload: bytes, dictionary: Mapping[bytes, bytes] | None = None) -> bytes:
    if method == "store":
        return payload
    return inflate(payload) if method == "zlib" else BlobFile.decode(payload).output(dictionary)


@dataclass(frozen=True)
class Entry:
    """Metadata of an archive entry; its payload is at ``offset`` and ``compressed_size`` long."""

    path: str
    method: str
    original_size: int
    compressed_size: int
    offset: int

    @property
    def ratio(self) -> float:
        return self.compressed_size / self.original_size if self.original_size else 1.0


def archive_header(entries: int, dictionary: Mapping[bytes, bytes] | None = None) -> bytes:
    out = ARCHIVE_MAGIC + bytes([VERSION, HAS_DICTIONARY if dictionary else 0]) + struct.pack("<I", entries)
    if dictionary:
        section = _dictionary_section(dictionary)
        out += struct.pack("<I", len(section)) + section
    return out


def entry_frame(path: str, method: str, original_size: int, payload: bytes) -> bytes:
    name = path.encode()
    if len(payload) >= 1 << 32:
        raise FormatError("BAD_PAYLOAD", "an entry holds less than 4 GiB")
    return struct.pack("<H", len(name)) + name + struct.pack("<BQI", METHODS[method], original_size, len(payload)) + payload


def write_archive(entries: Iterable[tuple[str, str, int, bytes]], dictionary: Mapping[bytes, bytes] | None = None) -> bytes:
    frames = [entry_frame(*e) for e in entries]
    return archive_header(len(frames), dictionary) + b"".join(frames)


def read_header(r: Reader) -> tuple[int, dict[bytes, bytes]]:
    if r.take(4) != ARCHIVE_MAGIC:
        raise FormatError("BAD_MAGIC")
    if r.number("B") != VERSION:
        raise FormatError("BAD_VERSION")
    flags, count = r.number("B"), r.number("I")
    if not flags & HAS_DICTIONARY:
        return count, {}
    section = Reader(r.take(r.number("I")))
    return count, _read_dictionary(section)


def read_index(data: bytes) -> tuple[list[Entry], dict[bytes, bytes]]:
    """All entries' metadata, skipping payloads, and the archive's dictionary."""
    r = Reader(data, error="TOO_SHORT")
    count, dictionary = read_header(r)
    out = []
    for _ in range(count):
        path = r.take(r.number("H")).decode()
        method = METHOD_NAMES.get(r.number("B"))
        if method is None:
            raise FormatError("BAD_METHOD")
        original, size = r.number("Q"), r.number("I")
        out.append(Entry(path, method, original, size, r.at))
        r.take(size)
    if r.at != len(data):
        raise FormatError("COUNT_MISMATCH")
    return out, dictionary


def read_archive(data: bytes) -> Iterator[tuple[Entry, bytes]]:
    entries, dictionary = read_index(data)
    for e in entries:
        out = decode_entry(e.method, data[e.offset : e.offset + e.compressed_size], dictionary)
        if len(out) != e.original_size:
            raise FormatError("LENGTH_MISMATCH", e.path)
        yield e, out


def safe_path(path: str) -> str:
    """The path, if it stays inside the folder it is unpacked into."""
    parts = path.replace("\\", "/").split("/")
    if not path or path.startswith(("/", "\\")) or ".." in parts or ":" in parts[0]:
        raise FormatError("BAD_PATH", path)
    return path
