"""Benchmark decontamination by greedy string tiling.

Benchmark items are few against the documents: they are fitted in blocks of a checked size, and
every block goes over the documents once, so the documents are never shuffled. Within a block a
document's runs of ``MIN_MATCH`` tokens are looked up among the items' (the seed join); a document
that shares a seed with an item is tiled against it: the longest common run of unmarked tokens is
found, marked, and so on. Runs are compared by running Karp-Rabin hashes: prefix sums give the hash
of every run of one length in a single pass, so a length is tried in linear time and the longest is found
by bisection; whatever hashes say is equal is compared token by token before it is marked. Coverage is
the share of the item's tokens under tiles, wherever in the document they lie, so a passage whose
parts were put in another order is found as well.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import chunks, materialize, materialize_all, text_or_empty

#: Tokens in the shortest tile, and in a seed.
MIN_MATCH = 5
#: A document is contaminated by an item when its tiles cover this share of the item's tokens.
COVERAGE = 0.6
#: Characters of benchmark text in one block (a block is sent to every executor).
BLOCK_CHARS = 8_000_000

_TOKEN = re.compile(r"\w+")
_BASE = 0x9E3779B97F4A7C15


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


class _Vocabulary(dict):
    """Token -> number from 1; 0 for any other token, which matches nothing."""

    def __missing__(self, word: str) -> int:
        return 0

    def learn(self, words: list[str]) -> np.ndarray:
        return np.array([self.setdefault(w, len(self) + 1) for w in words], dtype=np.int64)

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


class _Runs:
    """Karp-Rabin hashes of all runs of a sequence, for any length, and which of its places are still free."""

    _up = _down = np.ones(1, np.uint64)

    def __init__(self, numbers: np.ndarray) -> None:
        n = len(numbers)
        if len(_Runs._up) <= n:
            size = max(1 << 12, 2 * n)
            _Runs._up = np.concatenate(([np.uint64(1)], np.full(size, _BASE, np.uint64))).cumprod(dtype=np.uint64)
            _Runs._down = np.concatenate(([np.uint64(1)], np.full(size, pow(_BASE, -1, 1 << 64), np.uint64))).cumprod(dtype=np.uint64)
        x = numbers.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        self.numbers, self.free = numbers, numbers > 0
        self.sums = np.concatenate(([np.uint64(0)], np.cumsum(x * self._up[:n], dtype=np.uint64)))

    def of(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the runs of free tokens of this length."""
        count = len(self.numbers) - length + 1
        if count <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        taken = np.concatenate(([0], np.cumsum(~self.free)))
        at = np.flatnonzero(taken[length:] == taken[:count])
        return at, (self.sums[at + length] - self.sums[at]) * self._down[at]

    def is_free(self, at: int, length: int) -> bool:
        return bool(self.free[at : at + length].all())

    def mark(self, at: int, length: int) -> None:
        self.free[at : at + length] = False


def greedy_tiles(item: list[str], text: list[str], least: int) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in text, length), longest first, none overlapping another in either.

    Ties go to the earliest place in the item, then in the text.
    """
    known = _Vocabulary()
    return _tiles(known.learn(item), known.numbers(text), least)


def _tiles(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """``greedy_tiles`` of numbered tokens; zeros match nothing."""
    a, b, out = _Runs(item), _Runs(text), []
    length = _longest(a, b, least, min(len(item), len(text)))
    while length >= least:
        out += _mark(a, b, length)
        length = _longest(a, b, least, length - 1)
    return out


def _longest(a: _Runs, b: _Runs, least: int, most: int) -> int:
    """The greatest length up to ``most`` at which free runs have equal hashes, ``least`` - 1 if there is none.

    It is never less than that of the longest common free run: shorter parts of it have equal hashes too.
    """
    low, high = least - 1, most + 1
    while high - low > 1:
        middle = least if low < least else (low + high) // 2
        if np.isin(a.of(middle)[1], b.of(middle)[1]).any():
            low = middle
        else:
            high = middle
    return low


def _mark(a: _Runs, b: _Runs, length: int) -> Iterator[tuple[int, int, int]]:
    """Mark the common free runs of this length, from the left of ``a``, each with the first free place in ``b``."""
    starts, hashes = a.of(length)
    places, others = b.of(length)
    order = np.argsort(others, kind="stable")
    places, others = places[order], others[order]
    first, last = np.searchsorted(others, hashes), np.searchsorted(others, hashes, side="right")
    passed: dict[int, int] = {}  # places up to here are taken for good
    for k in np.flatnonzero(last > first).tolist():
        at, begin, end = int(starts[k]), int(first[k]), int(last[k])
        if not a.is_free(at, length):
            continue
        place = passed.get(begin, begin)
        while place < end and not b.is_free(int(places[place]), length):
            place += 1
        passed[begin] = place
        for p in places[place:end].tolist():
            if b.is_free(p, length) and np.array_equal(a.numbers[at : at + length], b.numbers[p : p + length]):
                a.mark(at, length)
                b.mark(p, length)
                yield at, p, length
                break


@dataclass
class ItemBlock:
    """Some benchmark items, their tokens as numbers of a common vocabulary, with the seeds that lead to them."""

    ids: list
    items: list

    def __post_init__(self) -> None:
        self.known = _Vocabulary()
        self.items = [self.known.learn(t) for t in self.items]
        # A shorter item is its own seed; an item without any token matches nothing.
        self.least = [min(MIN_MATCH, len(t)) for t in self.items]
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sorted(set(self.least) - {0}):
            own = [k for k, least in enumerate(self.least) if least == n]
            runs = [np.unique(_Runs(self.items[k]).of(n)[1]) for k in own]
            values, owners = np.concatenate(runs), np.repeat(own, [len(r) for r in runs])
            order = np.argsort(values, kind="stable")
            self.seeds[n] = values[order], owners[order]

    def coverage(self, text: str | None, share: float = 0.0) -> dict[int, tuple[int, int]]:
        """Items that share a seed with the text -> (tokens under tiles, tiles).

        Items of which seeds in the text cover less than ``share`` may be left out: tiles cover no more.
        """
        numbers = self.known.numbers(tokens(text))
        found: set[int] = set()
        runs = _Runs(numbers) if numbers.any() else None
        for n, (values, owners) in self.seeds.items() if runs else ():
            own = np.unique(runs.of(n)[1])
            first, last = np.searchsorted(values, own), np.searchsorted(values, own, side="right")
            for k in np.flatnonzero(last > first).tolist():
                found.update(owners[first[k] : last[k]].tolist())
        out = {}
        for k in sorted(found):
            tiles = self._tile(k, runs, share)
            if tiles:
                out[k] = sum(t[2] for t in tiles), len(tiles)
        return out

    def tile(self, k: int, words: list[str]) -> list[tuple[int, int, int]]:
        """Tiles of item ``k`` in the text; places are those in the stretches around shared seeds."""
        return self._tile(k, _Runs(self.known.numbers(words)))

    def _tile(self, k: int, runs: _Runs, share: float = 0.0) -> list[tuple[int, int, int]]:
        item, least = self.items[k], self.least[k]
        (a, own), (b, others) = _Runs(item).of(least), runs.of(least)
        if share and _under(a[np.isin(own, others)], least, len(item)).sum() < share * len(item):
            return []
        # Tokens outside any shared seed can be in no tile; they are replaced by one gap each run.
        keep = np.flatnonzero(_under(b[np.isin(others, own)], least, len(runs.numbers)))
        return _tiles(item, np.insert(runs.numbers[keep], np.flatnonzero(np.diff(keep) > 1) + 1, 0), least)


def _under(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of ``n`` places are in a run of this length that starts at one of ``starts``."""
    edges = np.zeros(n + 1, np.int64)
    edges[starts] += 1
    np.subtract.at(edges, starts + length, 1)
    return np.cumsum(edges[:n]) > 0


def item_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[ItemBlock]:
    """The items in blocks of at most ``block_chars`` characters (or one item), fetched one at a time."""
    rows = benchmark.select("item_id", text_or_empty().alias("text")).distinct()
    ids, items, size = [], [], 0
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        if items and size + len(row["text"]) > block_chars:
            yield ItemBlock(ids, items)
            ids, items, size = [], [], 0
        ids.append(row["item_id"])
        items.append(tokens(row["text"]))
        size += len(row["text"])
    if items:
        yield ItemBlock(ids, items)


def find_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Pairs of a document and a benchmark item it contains: doc_id, item_id, n_tokens, covered, tiles, coverage.

    One row per row of ``docs`` (doc_id, text) and distinct (item_id, text) of ``benchmark`` whose
    coverage reaches the threshold. Tokens are runs of letters and digits in lower case, so case,
    punctuation and white space do not hide a passage. Items of fewer than five tokens must occur as
    a whole. Null and empty texts match nothing; a null id is carried through. Other columns are
    ignored. An empty table on either side gives an empty result.

    A benchmark of several blocks is worked through block by block, each over all documents, and what one finds is
    written before the next is fetched: driver, plan and workers hold one block at a time.
    """
    ids = {n: d.schema[n].dataType.simpleString() for d, n in ((docs, "doc_id"), (benchmark, "item_id"))}
    schema = f"doc_id {ids['doc_id']}, item_id {ids['item_id']}, n_tokens long, covered long, tiles long, coverage double"
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    item_type = benchmark.schema["item_id"].dataType
    found = lambda block: rows.mapInArrow(_leaks_of(block, coverage, item_type), schema)
    blocks = item_blocks(benchmark, block_chars)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return docs.sparkSession.createDataFrame([], schema)
    if second is None:
        return found(first)
    return materialize_all(found(b) for b in chain((first, second), blocks))


def _leaks_of(block: ItemBlock, coverage: float, item_type):
    from pyspark.sql.pandas.types import to_arrow_type

    arrow_type = to_arrow_type(item_type)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            rows, out = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for k, (covered, tiles) in block.coverage(text, coverage).items():
                    if covered >= coverage * len(block.items[k]):
                        rows.append(i)
                        out.append((block.ids[k], len(block.items[k]), covered, tiles, covered / len(block.items[k])))
            item, n, covered, tiles, share = zip(*out) if out else ([],) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(item, arrow_type)]
                + [pa.array(x, pa.int64()) for x in (n, covered, tiles)] + [pa.array(share, pa.float64())],
                names=["doc_id", "item_id", "n_tokens", "covered", "tiles", "coverage"],
            )

    return run


def drop_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` without the rows that contain a benchmark item; a filter on each row, no shuffle.

    Null and empty texts are kept, as are all rows where the benchmark is empty; equal rows stay or go together and
    columns are as they were. With a benchmark of several blocks, what is left after a block is written before the next.
    """
    clean = lambda df, block: df.filter(_clean(block, coverage)(F.col("text").cast("string")))
    blocks = item_blocks(benchmark, block_chars)
    first, second = next(blocks, None), next(blocks, None)
    if second is None:
        return docs if first is None else clean(docs, first)
    for block in chain((first, second), blocks):
        docs = materialize(clean(docs, block))
    return docs


def _clean(block: ItemBlock, coverage: float):
    def contaminated(text: str | None) -> bool:
        return any(covered >= coverage * len(block.items[k]) for k, (covered, _) in block.coverage(text, coverage).items())

    @arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        parts = (texts.slice(at, 512).to_pylist() for at in range(0, len(texts), 512))
        return pa.array([not contaminated(t) for part in parts for t in part], pa.bool_())

    return clean


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    """All leaks of ``benchmark`` into ``documents``; odd rows as in ``find_leaks``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
