"""Removal of repeated byte strings over the whole corpus, by suffix sorting of what can repeat.

A byte goes if a 100-byte string over it also starts earlier. Three passes over ranges of documents:

1. *Anchors.* In each window of 100 bytes the 20-gram with the least hash is the window's anchor. Equal
   windows have equal anchors at equal places, so windows whose anchor occurs once in the corpus are
   unique. Consecutive windows with one anchor make a run; all a run's windows lie in its context. Each
   range sends its distinct pairs of (anchor, context) hashes to the anchors' partition, which answers for each
   pair: its anchor has another context or its context is in another range (to be sorted), its anchor has very
   many contexts (to be sorted by single windows), or nothing.
2. *Suffixes.* Runs to be sorted send their context, once per range, to the suffix bucket of their anchor;
   where an anchor has very many contexts, single windows go to the bucket of their own hash. Each
   bucket puts equal contexts together, sorts the suffixes of the others with a difference cover
   (``suffixes.py``) and returns the stretches of windows that also start earlier.
3. *Removal.* Each range marks its repeated windows and removes their union.

Hashes only say what may be equal. Whatever is removed has been compared byte by byte: contexts within their
range or as keys of a bucket, windows by the suffix sort. A collision costs a comparison, never a byte.

Ranges follow doc_id, so "earlier" between ranges is a comparison of their numbers, and whatever repeats
within a range is sent once: of a document with any number of copies an anchor's partition sees one pair
per range. What moves are packed blobs, not rows for each window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_range, materialize, shuffle_partitions, small_batches, text_or_empty
from .suffixes import WINDOW, repeated_windows

#: Length of an anchor, and the windows' number of places for it.
ANCHOR = 20
PLACES = WINDOW - ANCHOR + 1
#: An anchor with more distinct contexts than this sends single windows.
CROWDED = 4096
#: Bytes of text that are hashed at once.
CHUNK = 1 << 18
#: Bytes of text in a range of documents, of which a task holds one, at most; smaller ones are made for all cores, not below the least.
RANGE_BYTES, LEAST_BYTES = 1 << 28, 1 << 22
#: Pairs of one anchor that an anchors' partition should hold; a range with its share of them calls the anchor crowded.
ANCHOR_PAIRS, LEAST_CROWDED = 1 << 22, 16
#: What is known of a run: its context came before in the range; sort its windows; sort them one by one.
SEEN, SORT, SINGLE = 1, 2, 3
#: In place of a context's hash: all contexts of a crowded anchor.
ALL = np.uint64((1 << 64) - 1)

_RANDOM = np.random.default_rng(61).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xD6E8FEB86659FD93
_POWERS: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(_BASE)
    return x ^ (x >> np.uint64(29))


def _range_hash(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the bytes in [a, b) from prefix sums of byte values times powers."""
    return _mix((sums[b] - sums[a]) * _POWERS[0][len(_POWERS[0]) // 2 - a])


def _rolling(sums: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` bytes from each position; as ``_range_hash``, by slices."""
    count, middle = len(sums) - n, len(_POWERS[0]) // 2
    return _mix((sums[n:] - sums[:count]) * _POWERS[0][middle - count + 1 : middle + 1][::-1])


def _powers(n: int) -> np.ndarray:
    """Powers -n..n of the base, the zeroth in the middle (the base is odd, so it has an inverse)."""
    if not _POWERS or len(_POWERS[0]) < 2 * n + 1:
        n = max(n, CHUNK + WINDOW)
        up = np.concatenate(([np.uint64(1)], np.full(n, _BASE, np.uint64))).cumprod(dtype=np.uint64)
        down = np.concatenate(([np.uint64(1)], np.full(n, pow(_BASE, -1, 1 << 64), np.uint64))).cumprod(dtype=np.uint64)
        _POWERS[:] = [np.concatenate([down[:0:-1], up])]
    return _POWERS[0]


def runs(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: first window, number of windows, anchor hash, context hash.

    Long texts are cut between windows every ``CHUNK`` bytes; that only splits a run in two.
    """
    found = [_runs(text, at) for at in range(0, len(text) - WINDOW + 1, CHUNK)]
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2


def _runs(text: bytes, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    values = _RANDOM[np.frombuffer(text[at : at + CHUNK + WINDOW - 1], np.uint8)]
    n = len(values)
    powers = _powers(n)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(values * powers[len(powers) // 2 : len(powers) // 2 + n], dtype=np.uint64)))
    grams = _rolling(sums, ANCHOR)
    bits = np.uint64(21)  # the least hash; of equal ones the first
    least, width = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64), 1
    while width * 2 <= PLACES:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: n - WINDOW + 1], least[PLACES - width : PLACES - width + n - WINDOW + 1])
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    count = np.diff(np.concatenate((first, [len(least)])))
    anchor = (least[first] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    context = _range_hash(sums, first, first + count + WINDOW - 1)
    # A context's hash also tells how long it is and where its anchor lies.
    context = _mix(context + ((anchor - first) * 1024 + count).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return first + at, count, grams[anchor], context


def _window_hashes(context: bytes) -> np.ndarray:
    values = _RANDOM[np.frombuffer(context, np.uint8)]
    powers = _powers(len(values))
    sums = np.concatenate(([np.uint64(0)], np.cumsum(values * powers[len(powers) // 2 :][: len(values)], dtype=np.uint64)))
    return _rolling(sums, WINDOW)


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    """Partition of each key; anchors are least hashes, so their upper bits must be mixed first."""
    keys = _mix(keys ^ np.uint64(_BASE))
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)


def _blobs(array: np.ndarray, owner: np.ndarray, n: int) -> list[bytes]:
    """The rows of ``array`` of each owner 0..n-1, as bytes, in order."""
    order = np.argsort(owner, kind="stable")
    ends = np.searchsorted(owner[order], np.arange(n), side="right")
    rows = array[order]
    return [rows[a:b].tobytes() for a, b in zip(np.concatenate(([0], ends[:-1])), ends)]


def _anchors(parts: int, crowded: int):
    """One range -> (part, bucket, pairs): its distinct pairs; an anchor with over ``crowded`` of them sends one, with ``ALL``."""

    def run(table: pa.Table) -> pa.Table:
        found = [runs(t.as_buffer().to_pybytes())[2:] for t in table.column("text")]
        pairs = np.unique(np.stack([np.concatenate(c) for c in zip(*found)], axis=1), axis=0)
        _, first, group, size = np.unique(pairs[:, 0], return_index=True, return_inverse=True, return_counts=True)
        pairs[first[size > crowded], 1] = ALL
        keep = size[group] <= crowded
        keep[first] = True
        pairs = pairs[keep]
        blobs = _blobs(pairs, _part(pairs[:, 0], parts), parts)
        full = [p for p in range(parts) if blobs[p]]
        bucket = [table.column("bucket")[0].as_py()] * len(full)
        return pa.table({"part": pa.array(full, pa.int32()), "bucket": pa.array(bucket, pa.int32()), "pairs": pa.array([blobs[p] for p in full], pa.binary())})

    return run


def _answer(table: pa.Table, crowded: int) -> pa.Table:
    """All ranges' pairs of one partition of anchors -> (bucket, answers): (anchor, context or ``ALL``, code)."""
    blobs = [np.frombuffer(b.as_buffer(), np.uint64).reshape(-1, 2) for b in table.column("pairs")]
    buckets = np.repeat(table.column("bucket").to_numpy(), [len(b) for b in blobs]).astype(np.int64)
    pairs = np.concatenate(blobs)
    order = np.lexsort((buckets, pairs[:, 1], pairs[:, 0]))
    anchor, context, buckets = pairs[order, 0], pairs[order, 1], buckets[order]
    new_anchor = np.concatenate(([True], anchor[1:] != anchor[:-1]))
    new_context = new_anchor | np.concatenate(([True], context[1:] != context[:-1]))
    group, pair = np.cumsum(new_anchor) - 1, np.cumsum(new_context) - 1
    contexts = np.bincount(group, weights=new_context)
    many = ((contexts > crowded) | (np.bincount(group, weights=context == ALL) > 0))[group]
    sort = ~many & ((contexts[group] > 1) | (np.bincount(pair)[pair] > 1))
    crowd = np.unique(np.stack([buckets[many].astype(np.uint64), anchor[many]], axis=1), axis=0)
    rows = np.concatenate([
        np.stack([anchor[sort], context[sort], np.full(sort.sum(), SORT, np.uint64)], axis=1),
        np.stack([crowd[:, 1], np.full(len(crowd), ALL), np.full(len(crowd), SINGLE, np.uint64)], axis=1),
    ])
    names, owner = np.unique(np.concatenate([buckets[sort], crowd[:, 0].astype(np.int64)]), return_inverse=True)
    pa.default_memory_pool().release_unused()
    return pa.table({"bucket": pa.array(names, pa.int32()), "answers": pa.array(_blobs(rows, owner, len(names)), pa.binary())})


def _numbered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal numbers for equal pairs."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(np.concatenate(([0], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(order) else 0
    return out


class _Range:
    """The documents of one range in order, their runs, and what is to be done with each.

    ``code`` is ``SEEN`` for a run whose context is, byte by byte, that of an earlier run of the range.
    """

    def __init__(self, texts: list[bytes], answers: pa.Table) -> None:
        found = [runs(t) for t in texts]
        self.texts, self.doc = texts, np.repeat(np.arange(len(texts)), [len(f[0]) for f in found])
        self.start, self.count, self.anchor, context = (np.concatenate(c) for c in zip(*found))
        told = [np.frombuffer(b.as_buffer(), np.uint64).reshape(-1, 3) for b in answers.column("answers")]
        told = np.concatenate(told) if told else np.zeros((0, 3), np.uint64)
        n, single = len(self.start), told[:, 2] == SINGLE
        pair = _numbered(np.concatenate([self.anchor, told[~single, 0]]), np.concatenate([context, told[~single, 1]]))
        self.code = np.where(np.isin(pair[:n], pair[n:]), SORT, 0)
        self.code[np.isin(self.anchor, told[single, 0])] = SINGLE
        _, first, group = np.unique(pair[:n], return_index=True, return_inverse=True)
        first = first[group]
        for r in np.flatnonzero(first < np.arange(n)).tolist():
            f = int(first[r])
            if self.context(r) == self.context(f):
                self.code[r] = SEEN
            else:  # a collision: both are compared by their suffixes
                self.code[r], self.code[f] = max(self.code[r], SORT), max(self.code[f], SORT)

    def context(self, r: int) -> bytes:
        a = int(self.start[r])
        return self.texts[self.doc[r]][a : a + int(self.count[r]) + WINDOW - 1]

    def singles(self) -> Iterator[tuple[int, int, int, bool]]:
        """Single windows to sort, in order: (run, offset, hash, whether an equal one came before)."""
        seen: dict[int, tuple[int, int]] = {}
        window = lambda r, o: self.texts[self.doc[r]][int(self.start[r]) + o : int(self.start[r]) + o + WINDOW]
        for r in np.flatnonzero(self.code == SINGLE).tolist():
            for o, h in enumerate(_window_hashes(self.context(r)).tolist()):
                first = seen.setdefault(h, (r, o))
                yield r, o, h, first != (r, o) and window(*first) == window(r, o)


def _range_of(table: pa.Table, answers: pa.Table) -> tuple[pa.Table, _Range]:
    table = table.sort_by([("none", "ascending"), ("doc_id", "ascending"), ("key", "ascending")])
    return table, _Range([t.as_buffer().to_pybytes() for t in table.column("text")], answers)


def _segments(parts: int):
    """A range and its answers -> (part, bucket, keys, runs, offsets, ends, bytes) of what is to be sorted."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        out = {n: [] for n in ("part", "bucket", "keys", "runs", "offsets", "ends", "data")}
        if table.num_rows:
            bucket = table.column("bucket")[0].as_py()
            _, rng = _range_of(table, answers)
            items = [(int(rng.anchor[r]), r, 0, rng.context(r)) for r in np.flatnonzero(rng.code == SORT).tolist()]
            for r, o, h, before in rng.singles():
                if not before:
                    items.append((h, r, o, rng.context(r)[o : o + WINDOW]))
            keys = np.array([i[0] for i in items], dtype=np.uint64)
            owner = _part(keys, parts)
            for p in np.unique(owner).tolist():
                own = [items[k] for k in np.flatnonzero(owner == p).tolist()]
                out["part"].append(p)
                out["bucket"].append(bucket)
                out["keys"].append(np.array([i[0] for i in own], np.uint64).tobytes())
                out["runs"].append(np.array([i[1] for i in own], np.int64).tobytes())
                out["offsets"].append(np.array([i[2] for i in own], np.int32).tobytes())
                out["ends"].append(np.cumsum([len(i[3]) for i in own]).astype(np.int64).tobytes())
                out["data"].append(b"".join(i[3] for i in own))
        types = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
        return pa.table({n: pa.array(v, t) for (n, v), t in zip(out.items(), types)})

    return run


def _sort_suffixes(table: pa.Table) -> pa.Table:
    """One suffix bucket -> (bucket, marks): (run, offset, number of windows) of windows that also start earlier."""
    keys, runs_, offsets, owners, segments = [], [], [], [], []
    buckets = table.column("bucket").to_numpy()
    cell = lambda name, row: table.column(name)[row].as_buffer()
    for row in np.argsort(buckets, kind="stable").tolist():
        keys.append(np.frombuffer(cell("keys", row), np.uint64))
        runs_.append(np.frombuffer(cell("runs", row), np.int64))
        offsets.append(np.frombuffer(cell("offsets", row), np.int32))
        owners.append(np.full(len(runs_[-1]), buckets[row], np.int32))
        ends, data = np.frombuffer(cell("ends", row), np.int64).tolist(), memoryview(cell("data", row))
        segments += [data[a:b] for a, b in zip([0, *ends], ends)]  # views, not copies
    keys, runs_, offsets, owners = (np.concatenate(c) for c in (keys, runs_, offsets, owners))
    marks = _repeats(segments, keys)
    rows = np.stack([runs_[marks[:, 0]], offsets[marks[:, 0]] + marks[:, 1], marks[:, 2]], axis=1).astype(np.int64)
    names, owner = np.unique(owners[marks[:, 0]], return_inverse=True)
    pa.default_memory_pool().release_unused()
    return pa.table({"bucket": pa.array(names, pa.int32()), "marks": pa.array(_blobs(rows, owner, len(names)), pa.binary())})


def _repeats(segments: list[bytes | memoryview], keys: np.ndarray) -> np.ndarray:
    """Stretches (segment, first window, windows) that are also in an earlier segment of the same key.

    A segment equal to an earlier one is a stretch as it is; the suffixes of the others are sorted where their key has
    several.
    """
    first: dict[tuple[int, bytes], int] = {}
    equal = np.array([first.setdefault((k, bytes(s)), i) != i for i, (k, s) in enumerate(zip(keys.tolist(), segments))], dtype=bool)
    del first
    out = [(i, 0, len(segments[i]) - WINDOW + 1) for i in np.flatnonzero(equal).tolist()]
    rest = np.flatnonzero(~equal)
    _, group, size = np.unique(keys[rest], return_inverse=True, return_counts=True)
    rest = rest[size[group] > 1]
    found = repeated_windows([segments[i] for i in rest.tolist()], keys[rest], np.arange(len(rest)))
    for i, repeated in zip(rest.tolist(), found):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], repeated.view(np.int8), [0]))))
        out += [(i, a, b - a) for a, b in edges.reshape(-1, 2).tolist()]
    return np.array(out, dtype=np.int64).reshape(-1, 3)


def _remove(id_type: pa.DataType):
    """A range with its answers (rows with ``answers``) and marks (rows with ``marks``) -> what is kept."""

    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"]
        types = [id_type, pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
        if not table.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, types)})
        table, rng = _range_of(table, told.filter(told.column("answers").is_valid()))
        marks = [np.frombuffer(b.as_buffer(), np.int64).reshape(-1, 3) for b in told.column("marks").drop_null()]
        marks = np.concatenate(marks) if marks else np.zeros((0, 3), np.int64)
        single = np.array([(r, o, 1) for r, o, _, before in rng.singles() if before], dtype=np.int64).reshape(-1, 3)
        whole = np.flatnonzero(rng.code == SEEN)
        marks = np.concatenate([np.stack([whole, np.zeros_like(whole), rng.count[whole]], axis=1), marks, single])
        docs, first, count = rng.doc[marks[:, 0]], rng.start[marks[:, 0]] + marks[:, 1], marks[:, 2]
        order = np.lexsort((first, docs))
        docs, first, count = docs[order], first[order], count[order]
        edges = np.searchsorted(docs, np.arange(len(rng.texts) + 1))
        rows = []
        for d, text in enumerate(rng.texts):
            a, b = first[edges[d] : edges[d + 1]], (first + count + WINDOW - 1)[edges[d] : edges[d + 1]]
            if len(a):
                reach = np.maximum.accumulate(b)
                new = np.flatnonzero(np.concatenate(([True], a[1:] > reach[:-1])))
                starts, ends = a[new].tolist(), reach[np.concatenate((new[1:] - 1, [len(a) - 1]))].tolist()
            else:
                starts, ends = [], []
            kept = b"".join(text[x:y] for x, y in zip([0, *ends], [*starts, len(text)]))
            rows.append((len(text), len(text) - len(kept), len(starts), kept, hashlib.sha256(kept).hexdigest()))
        columns = [table.column("doc_id").combine_chunks(), *(pa.array(c, t) for c, t in zip(zip(*rows), types[1:]))]
        return pa.table(dict(zip(names, columns)))

    return run


def remove_repeats(docs: DataFrame, ranges: int | None = None, crowded: int = CROWDED, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept (the bytes left), kept_sha256; one row per row.

    Earlier means a smaller doc_id, null last; rows of equal doc_id are separate documents in order of a
    hash of their text, and of equal rows the first counts as earlier. Null texts are empty; texts of
    fewer than 100 bytes lose nothing. Cutting within a code point is possible, as bytes are judged.
    Other columns are ignored; an empty table gives an empty result.

    Memory: one range of documents in a task, about ``range_bytes`` of text (unless ``ranges`` sets their number)
    or the longest document, or one suffix bucket.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    small_batches(spark)
    # Every range may have a blob for every partition, so neither should be many where there is little text.
    total = docs.agg(F.sum(F.octet_length(text_or_empty()).cast("bigint"))).first()[0] or 0
    pieces = 1 + total // LEAST_BYTES
    ranges = ranges or max(min(4 * shuffle_partitions(spark), pieces), -(-total // range_bytes))
    parts = min(shuffle_partitions(spark), pieces)
    local = min(crowded, max(LEAST_CROWDED, ANCHOR_PAIRS // ranges))
    id_type = docs.schema["doc_id"].dataType
    rows = docs.select(
        "doc_id", F.col("doc_id").isNull().alias("none"), F.xxhash64(text_or_empty()).alias("key"),
        F.encode(text_or_empty(), "UTF-8").alias("text"),
    )
    rows = rows.withColumn("bucket", id_range(rows, ranges))
    grouped = rows.groupBy("bucket")
    pairs = rows.select("bucket", "text").groupBy("bucket").applyInArrow(_anchors(parts, local), "part int, bucket int, pairs binary")
    answers = materialize(pairs.groupBy("part").applyInArrow(lambda t: _answer(t, crowded), "bucket int, answers binary"))
    segments = grouped.cogroup(answers.groupBy("bucket")).applyInArrow(
        _segments(2 * parts), "part int, bucket int, keys binary, runs binary, offsets binary, ends binary, data binary"
    )
    marks = materialize(segments.groupBy("part").applyInArrow(_sort_suffixes, "bucket int, marks binary"))
    told = answers.withColumn("marks", F.lit(None).cast("binary")).unionByName(marks.withColumn("answers", F.lit(None).cast("binary")))
    schema = f"doc_id {id_type.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"
    return grouped.cogroup(told.groupBy("bucket")).applyInArrow(_remove(to_arrow_type(id_type)), schema)


def op6_repeats(spark, sf_dir: str) -> DataFrame:
    """What is left of every document of ``documents``; odd rows as in ``remove_repeats``."""
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
