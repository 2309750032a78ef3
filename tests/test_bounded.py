"""Memory is bounded by blocks, not by the blob or the batch; results are those of the whole."""

import random
import tracemalloc
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from byteplan.functions import udfs
from byteplan.kernels import dictionary, lz, profile, synth
from byteplan.operators import profiling
from byteplan.plans import pack
from byteplan.schema import render_rows


def lines(n, seed=0):
    r = random.Random(seed)
    return b"".join(b"%d,fixed,%s,%d\n" % (7 * k, r.choice([b"O", b"F", b"P"]), r.randrange(9000)) for k in range(n))


@pytest.fixture
def blocks(monkeypatch):
    """Positions that were searched together, under small blocks."""
    seen, found = [], lz._matches
    monkeypatch.setattr(lz, "TOGETHER", 5000)
    monkeypatch.setattr(lz, "_matches", lambda block, keys, *a: (seen.append(len(keys)), found(block, keys, *a))[1])
    return seen


def test_long_blobs_are_parsed_block_by_block(monkeypatch):
    blobs = [b"", lines(6000), b"a" * 20_000, b"x", random.Random(1).randbytes(9000) * 2, lines(20)]
    ways = [lambda: list(lz.parse_many(blobs)), lambda: list(lz.parse_far_many(blobs)), lambda: list(lz.parse_far_many(blobs, 300, 4000)), lambda: list(lz.compress_naive_many(blobs))]
    monkeypatch.setattr(lz, "TOGETHER", 1 << 30)
    whole = [way() for way in ways]
    for size in (100_000, 999):
        monkeypatch.setattr(lz, "TOGETHER", size)
        assert [way() for way in ways] == whole


def test_a_block_is_all_that_is_searched_at_once(blocks):
    sum(t.length for t in lz.parse(lines(6000)))
    assert len(blocks) > 20 and max(blocks) <= 5000 + lz.WINDOW + lz.MAX_MATCH + 8


def test_statistics_are_those_of_the_tokens(spark):
    texts = [lines(4000, seed) for seed in range(8)] + [b"", b"abc"]
    whole = [lz.parse(t) for t in texts]
    got = list(udfs.lz_statistics(texts))
    assert [(g["n_literals"], g["n_matches"], g["literal_bytes"], g["match_bytes"]) for g in got] == [
        (sum(not t.offset for t in p), sum(t.offset > 0 for t in p), sum(t.length for t in p if not t.offset), sum(t.length for t in p if t.offset)) for p in whole
    ]
    rows = spark.createDataFrame([("c", None, None, None), ("c", "e", b"", 0), ("c", "x", texts[0], len(texts[0]))], "corpus string, path string, content binary, length long")
    out = {r["path"]: r for r in profiling.lz_statistics(rows).collect()}
    assert out[None]["n_literals"] is None and out["e"]["literal_fraction"] == 1.0 and out["x"]["n_matches"] == got[0]["n_matches"]


def test_tokens_are_handed_over_in_bounded_arrays(monkeypatch, spark):
    texts = [None, lines(300), b"", b"abc", *[lines(40, seed) for seed in range(30)], None, b"\x00" * 900]
    kind = to_arrow_type(_parse_datatype_string(udfs._TOKENS))
    monkeypatch.setattr(udfs, "TOKENS_AT_ONCE", 200)
    arrays = list(udfs.lz_tokens(texts, kind))
    assert len(arrays) > 10 and all(len(a.flatten()) < 200 + max(len(lz.parse(t)) for t in texts if t) for a in arrays)
    want = [
        None if t is None else [{"ord": k, "kind": x.kind, "start": x.start, "len": x.length, "offset": x.offset, "data": None if x.offset else t[x.start : x.start + x.length]} for k, x in enumerate(lz.parse(t))]
        for t in texts
    ]
    assert [x for a in arrays for x in a.to_pylist()] == want
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "path int, content binary")
    got = {r["path"]: r["t"] for r in rows.select("path", udfs.functions()["lz_tokens"]("content").alias("t")).collect()}
    assert [got[k] and [x.asDict() | {"data": x["data"] and bytes(x["data"])} for x in got[k]] for k in range(len(texts))] == want


def test_similarity_holds_two_lines_and_synthesis_no_lists_of_tokens():
    data = lines(20_000)
    for work, most in ((lambda: profile.line_similarity(data), 4), (lambda: synth.compress(data), 60)):
        tracemalloc.start()
        work()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < most * len(data) + 150 * lz.TOGETHER * (most > 4)


def test_rendered_rows_keep_order_nulls_and_ties(spark):
    rows = [("a", 2, "x"), ("a", None, "n"), ("a", 1, None), ("a", 2, "w"), (None, 5, "q"), ("é", 1, "ü"), (None, 4, None), ("b", 1, "")] + [("long", k, "y" * 9) for k in range(25_000)]
    df = spark.createDataFrame(rows, "g string, o int, v string").repartition(7)
    got = {r["path"]: r["content"] for r in render_rows(df, F.col("g"), ["o"], [F.col("o").cast("string"), F.lit("k"), F.col("v")]).collect()}
    assert got == {"a": "k,n\n1,k\n2,k,w\n2,k,x\n", None: "4,k\n5,k,q\n", "é": "1,k,ü\n", "b": "1,k,\n", "long": "".join(f"{k},k,{'y' * 9}\n" for k in range(25_000))}


def test_mining_makes_a_program_once_for_each_blob(spark):
    blobs = [b"prefix %d says: the quick brown fox jumps over; " % k + random.Random(k).randbytes(300) for k in range(12)] + [b"", None]
    df = spark.createDataFrame([("all", str(k), b, len(b or b"")) for k, b in enumerate(blobs)], "corpus string, path string, content binary, length long").repartition(3)
    pieces = [synth.compress(b).program.literals() for b in blobs if b]
    files = Counter(p for found in pieces for p in set().union(*map(dictionary.strided_patterns, found)))
    seen = sum(map(bool, pieces))
    best = sorted((-c, -len(p), p) for p, c in files.items() if c >= max(2, seen // 10) and profile.entropy(p) >= dictionary.MIN_ENTROPY)[: dictionary.STRIDED_SIZE]
    want = {dictionary.short_key(k): p for k, (_, _, p) in enumerate(best)}
    assert pack.mine_dictionary(df, min_size=0) == (want if dictionary.net_gain(want, seen) >= dictionary.MIN_NET_GAIN else {})
