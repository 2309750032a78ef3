"""Document fingerprints by Order MinHash.

A text's k-mers are numbered by occurrence, so repeats count. Each of ``SIGNATURES`` hash functions
selects the ``PICK`` minimal numbered k-mers; their k-mers, *in text order*, are hashed together. Two
texts agree in a component about as often as they share content in the same order, which follows
edit distance more closely than sets of k-mers do.

For each document the query also fingerprints a text edited with the start of its neighbour in descending doc_id.
Neighbours are found without a global sort: ids are cut into ranges, each range is sorted and streamed
by one task, and the first row of the next range is copied to the end of the one before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import chunks, id_range, shuffle_partitions, text_or_empty

#: Code points in a k-mer (a power of two), hash functions, k-mers each selects.
K, SIGNATURES, PICK = 8, 32, 2
#: k-mers that are hashed by all functions at once.
BLOCK = 1 << 15

_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(0, 1 << 32, SIGNATURES, dtype=np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, SIGNATURES, dtype=np.uint32)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finalizer of a well-known generator)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def kmers(text: str) -> np.ndarray:
    """A hash of each k-mer; a shorter text is one k-mer, an empty one has none."""
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    if 0 < len(h) < K:
        h = np.concatenate([h, np.zeros(K - len(h), np.uint64)])
    base, step = 0x9E3779B97F4A7C15, 1
    while step < K and len(h):
        h = h[: len(h) - step] * np.uint64(base) + h[step:]
        base, step = base * base % (1 << 64), step * 2
    return _mix(h)


def number_occurrences(x: np.ndarray) -> np.ndarray:
    """How many equal k-mers precede each one."""
    bits = np.uint64(max(1, int(len(x)).bit_length()))
    order = np.sort((x >> bits << bits) | np.arange(len(x), dtype=np.uint64))  # by k-mer, then place
    place, group = order & ((np.uint64(1) << bits) - np.uint64(1)), order >> bits
    index = np.arange(len(x))
    first = np.maximum.accumulate(np.where(np.concatenate(([True], group[1:] != group[:-1])), index, 0))
    out = np.empty(len(x), np.uint64)
    out[place.astype(np.int64)] = (index - first).astype(np.uint64)
    return out


def _smallest(values: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and place of a few minimal values of each hash function, at least ``PICK`` where there are."""
    h = (values[None, :] ^ _B[:, None]) * _A[:, None]
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x85EBCA6B)
    n = len(values)
    if n > 64:
        rows, cols = np.nonzero(h < np.uint32(min(2**32 - 1, 2**32 * 12 // n)))
        if np.bincount(rows, minlength=SIGNATURES).min() >= PICK:
            return rows, h[rows, cols], cols + at
    pick = min(PICK, n)
    cols = np.argpartition(h, pick - 1, axis=1)[:, :pick] if pick < n else np.broadcast_to(np.arange(n), (SIGNATURES, n))
    rows = np.repeat(np.arange(SIGNATURES), pick)
    cols = cols.ravel()
    return rows, h[rows, cols], cols + at


def order_minhash(text: str) -> np.ndarray:
    """The ``SIGNATURES`` 32-bit components; all zero for an empty text."""
    x = kmers(text)
    if not len(x):
        return np.zeros(SIGNATURES, np.uint32)
    numbered = (_mix(x + number_occurrences(x) * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(32)).astype(np.uint32)
    found = [_smallest(numbered[at : at + BLOCK], at) for at in range(0, len(x), BLOCK)]
    rows, hashes, places = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((places, hashes, rows))
    rows, places = rows[order], places[order]
    first = np.searchsorted(rows, np.arange(SIGNATURES))
    pick = min(PICK, len(x))
    chosen = np.sort(np.stack([places[first + i] for i in range(pick)], axis=1), axis=1)
    out = np.full(SIGNATURES, pick, np.uint64)
    for i in range(pick):
        out = _mix(out * np.uint64(0x9FB21C651E98DF25) + x[chosen[:, i]])
    return (out >> np.uint64(32)).astype(np.uint32)


def as_hex(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal components."""
    return float((a == b).mean())


def _ranges(rows: DataFrame, ranges: int) -> tuple[DataFrame, int]:
    """``rows`` (doc_id, key, text) with bucket and tail; buckets are in descending order of doc_id.

    Null ids come last, in buckets by their key. The first row of each bucket is repeated in the one
    before with ``tail`` set, and that of the first bucket in the last one. The driver handles one
    number per bucket.
    """
    numbered = rows.withColumn("bucket", id_range(rows, ranges, descending=True))
    heads = numbered.groupBy("bucket").agg(F.max(F.struct("doc_id", F.bitwise_not("key"))).alias("head"))
    heads = sorted((r["bucket"], r["head"][1]) for r in heads.collect())
    before = {b: heads[i - 1][0] for i, (b, _) in enumerate(heads)}
    head_key = {b: ~k for b, k in heads}

    @arrow_udf("int")
    def copy_to(bucket: pa.Array, key: pa.Array) -> pa.Array:
        return pa.array([before[b] if head_key[b] == k else None for b, k in zip(bucket.to_pylist(), key.to_pylist())], pa.int32())

    places = F.filter(
        F.array(F.struct("bucket", F.lit(False).alias("tail")), F.struct(F.col("copy").alias("bucket"), F.lit(True).alias("tail"))),
        lambda p: p["bucket"].isNotNull(),
    )
    placed = numbered.withColumn("copy", copy_to("bucket", "key")).select("doc_id", "key", "text", F.explode(places).alias("p"))
    return placed.select("doc_id", "key", "text", "p.bucket", "p.tail"), len(heads)


_SCHEMA = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_neighbours(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Fingerprints of each text of (doc_id, text) and of its edited text; see the columns in ``_SCHEMA``.

    The edited text has its last third (rounded down) replaced by as many first code points of the next
    document in descending doc_id, the first document following the last. Null ids come last, equal ids
    are ordered by a hash of their text, and equal rows follow one another; a single row is its own
    neighbour. Null texts are empty; two empty texts are alike (1). Other columns are ignored; an empty table gives an
    empty result. Every range has a partition of its own, streamed row by row: memory is a few times the longest text.
    """
    spark = docs.sparkSession
    ranges = ranges or max(64, 2 * shuffle_partitions(spark))
    rows = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("key"), text_or_empty().alias("text"))
    placed, _ = _ranges(rows, ranges)
    placed = placed.repartitionById(2 * ranges + 1, "bucket")  # a range each; null ids have as many again
    placed = placed.sortWithinPartitions("bucket", "tail", F.desc_nulls_last("doc_id"), "key")
    id_type = docs.schema["doc_id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        types = [id_arrow, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        held = None  # the row whose next one is awaited: bucket, id, text, signature
        for batch in chunks(batches):
            out = []
            for doc_id, text, bucket, tail in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "bucket", "tail"))):
                if tail and held is None:
                    continue  # another row equal to the next range's first
                signature = order_minhash(text)
                if held is not None:
                    _, own_id, own, own_signature = held
                    n = len(own)
                    edited = own[: n - n // 3] + text[: n // 3]
                    edited_signature = order_minhash(edited)
                    out.append((
                        own_id, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), as_hex(own_signature),
                        as_hex(edited_signature), likeness(own_signature, edited_signature), likeness(own_signature, signature),
                    ))
                held = None if tail else (bucket, doc_id, text, signature)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    id_arrow = to_arrow_type(id_type.dataType)
    return placed.mapInArrow(run, f"doc_id {id_type.dataType.simpleString()}, {_SCHEMA}")


def op2_fingerprint(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document of ``documents``; odd rows as in ``fingerprint_neighbours``."""
    return fingerprint_neighbours(spark.read.parquet(f"{sf_dir}/documents.parquet"))
