"""Held-out dictionaries are those of all patterns, though slices of blobs name only their best."""

import random
import tracemalloc
from collections import Counter

import pytest

from byteplan.kernels import dictionary, lz, substrings
from byteplan.kernels.vm import HALT
from byteplan.operators import mining
from byteplan.schema import BLOBS


def lines(n, seed):
    r = random.Random(seed)
    return b"".join(b"%d,fixed,%s,%d\n" % (7 * k, r.choice([b"O", b"F", b"P"]), r.randrange(900)) for k in range(n))


def blob(r, n):
    if r.random() < 0.3:
        return (b"hello the world\n" * 40)[:n]
    return bytes(r.choice(r.choice([b"ab", b"\0\1", b"\0", b"abcdef\xff"])) for _ in range(n))


def test_slices_count_every_substring():
    r = random.Random(0)
    for _ in range(120):
        data, (shortest, longest), size = blob(r, r.choice([0, 1, 6, 8, 20, 60, 150, 400])), r.choice([(6, 48), (1, 3), (2, 7), (6, 6), (4, 100), (13, 14), (14, 15), (20, 48)]), r.choice([1000, 50, 13, 3])
        parts = list(substrings.slices(data, longest, size))
        want, got = dictionary.substring_counts(data, shortest, longest), Counter()
        asked = [*list(want)[:200], b"not there", b"a" * longest]
        for starts, part in parts:
            here = Counter(part[i : i + n] for i in range(starts) for n in range(shortest, longest + 1) if i + n <= len(part))
            for most in (0, 1, 10, 1 << 30):
                patterns, counts, bound = substrings.best_substrings(part, starts, shortest, longest, most, len(parts) == 1)
                named = dict(zip(patterns, counts))
                assert len(named) == len(patterns) <= most and all(here[p] == n >= 2 for p, n in named.items())
                rest = [n * (len(p) - dictionary.REF_COST) for p, n in here.items() if p not in named and (n >= 2 or len(parts) > 1)]
                assert max(rest, default=0) <= bound
            assert len(named) == sum(n >= 2 for n in here.values())
            got.update(dict(zip(asked, substrings.count_substrings(part, starts, asked))))
        assert all(got[p] == n for p, n in want.items() if p in asked) and not got[b"not there"]


def test_memory_goes_with_the_slice():
    data = lines(150_000, 0)
    peaks = []
    for part in (data[: 2 * substrings.SLICE], data):
        tracemalloc.start()
        for starts, piece in substrings.slices(part, 48):
            substrings.count_substrings(piece, starts, substrings.best_substrings(piece, starts, 6, 48, 1000, False)[0])
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert len(data) > 10 * substrings.SLICE and peaks[1] < 1.5 * peaks[0] and peaks[1] < 120 * substrings.SLICE


@pytest.mark.parametrize("size, named", [(5000, (400,)), (700, (5, 400)), (1 << 18, (3,)), (900, ())])
def test_dictionaries_are_those_of_all_patterns(spark, monkeypatch, size, named):
    monkeypatch.setattr(substrings, "SLICE", size)
    monkeypatch.setattr(mining, "NAMED", named)
    phrases = b"the first of them; " * 9, b"the first of them, " * 7 + b"x", b"of them; of them; the first; the first", b"", b"\x00\xff" * 40
    corpora = {"log": [lines(600, k) for k in range(5)], None: [*phrases, None], "one": [b"alone alone alone "]}
    rows = [(c, str(k), b, len(b or b"")) for c, blobs in corpora.items() for k, b in enumerate(blobs)]
    rows += [("same", None, phrases[0], 0), ("same", None, phrases[0], 0), ("same", "x", phrases[1], 0), ("same", "y", phrases[2], 0), ("same", "y", phrases[0], 0)]
    got = mining.held_out_dictionaries(spark.createDataFrame(rows, BLOBS).repartition(3), n=12).collect()
    assert len(got) == len(rows)
    for r in got:
        others = [b or b"" for c, p, b, _ in rows if c == r["corpus"] and p != r["path"]]
        assert [bytes(p) for p in r["patterns"] or []] == list(dictionary.mine_across(others, n=12).values())


def test_only_named_patterns_are_counted_where_they_settle_it(spark, monkeypatch):
    def file_patterns(*_):
        raise AssertionError("every substring of every blob was counted")

    monkeypatch.setattr(mining, "file_patterns", file_patterns)
    blobs = {str(k): lines(6000, k) for k in range(6)}
    rows = spark.createDataFrame([("k", p, b, len(b)) for p, b in blobs.items()], BLOBS)
    got = {r["path"]: [bytes(p) for p in r["patterns"]] for r in mining.held_out_dictionaries(rows).collect()}
    assert set(got) == set(blobs) and all(len(p) == 50 for p in got.values())
    assert got["2"] == list(dictionary.mine_across([b for p, b in blobs.items() if p != "2"]).values())


def test_references_are_made_some_at_a_time(monkeypatch):
    data, words = lines(60_000, 1), {0: b",fixed,", 7: b",fixed,O,", 300: b"1,"}
    whole = dictionary.compress_with_references(data, words)
    assert dictionary.decompress_with_references(whole, words) == data
    for at_once in (1, 1000):
        monkeypatch.setattr(dictionary, "TOGETHER", at_once)
        for part in (data[:3000], b"", b"1,", data if at_once > 1 else b"none"):
            found = dictionary.find_matches(part, words)
            edges = [0, *(x for start, end, _ in found for x in (start, end)), len(part)]
            programs = [lz.compress_naive(part[a:b], window=32768, halt=False) for a, b in zip(edges[::2], edges[1::2])] if len(part) <= 3000 else None
            got = dictionary.compress_with_references(part, words)
            assert got == (whole if programs is None else programs[0] + b"".join(dictionary.reference(k) + p for (_, _, k), p in zip(found, programs[1:])) + bytes([HALT]))
    assert len(dictionary.find_matches(data, words)) > 50_000
    tracemalloc.start()
    dictionary.compress_with_references(data, words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * len(data) + 1000 * 1000  # the program, and what 1,000 references take
