"""Predicted against measured benefit, and snapshots, against brute force."""

import zlib

import pytest

from byteplan.kernels import containers, dictionary, leb, lz
from byteplan.kernels.profile import entropy
from byteplan.operators import benefit, mining, snapshots
from byteplan.schema import BLOBS

TEXTS = {
    "a": b"the order of the house, the order of the day; " * 30,
    "b": b"the house of the order; the day of the house, " * 20,
    "c": bytes(range(256)),
    "d": b"",
    "e": b"the order of the house",
    "f": b"the order of the house",
    "g": b"x" * 20_000,
}


@pytest.fixture(scope="module")
def blobs(spark):
    return spark.createDataFrame([("all", p, b, len(b)) for p, b in TEXTS.items()] + [("all", "null", None, None)], BLOBS)


def sizes(data, patterns):
    plain = len(zlib.compress(lz.compress_naive(data), 1))
    program = dictionary.compress_with_references(data, dict(enumerate(patterns)))
    return plain, len(zlib.compress(program, 1)) if patterns else plain


def test_measured_benefit(spark):
    words = [b"the order", b" of the house"]
    chosen = {"a": words, "b": [], "c": None, "d": words, "e": words, "f": words, "g": [b"xxxx"], "null": words}
    rows = spark.createDataFrame([(p, TEXTS.get(p), w, "more") for p, w in chosen.items()], "path string, content binary, patterns array<binary>, benefit string")
    got = {r["path"]: r for r in benefit.measured(rows).collect()}
    assert set(got) == set(chosen)
    for path, patterns in chosen.items():
        data, patterns, r = TEXTS.get(path) or b"", patterns or [], got[path]
        plain, referenced = sizes(data, patterns)
        assert (r["plain"], r["referenced"], r["n_patterns"]) == (plain, referenced, len(patterns))
        assert r["benefit"] == pytest.approx((plain - referenced) / plain) and r["helps"] == ((plain - referenced) / plain > 0.01)
        found = dictionary.predict_benefit(data, dict(enumerate(patterns)))
        assert r["coverage"] == pytest.approx(found["coverage"]) and r["correct"] == (found["predicts_benefit"] == r["helps"])
    assert benefit.measured(rows.limit(0)).collect() == []


def test_curve_and_crossings(spark, blobs):
    ranked = [b"the ", b" of the house", b"order", b"day", b"xxxx"]
    curve = benefit.benefit_curve(blobs.repartition(3), ranked, (0, 1, 2, 4, 500))
    got = {r["n"]: r for r in curve.collect()}
    assert sorted(got) == [1, 2, 4, 5]
    for n, r in got.items():
        pairs = [sizes(d, ranked[:n]) for d in [*TEXTS.values(), b""]]
        covered = sum(e - s for d in TEXTS.values() for s, e, _ in dictionary.find_matches(d, dict(enumerate(ranked[:n]))))
        assert (r["covered"], r["total"]) == (covered, sum(map(len, TEXTS.values())))
        assert (r["plain"], r["referenced"]) == tuple(map(sum, zip(*pairs)))
        assert r["h_pattern"] == pytest.approx(entropy(b"".join(ranked[:n])))
    assert benefit.benefit_curve(blobs, []).collect() == [] and benefit.benefit_curve(blobs.limit(0), ranked).collect() == []
    made = spark.createDataFrame([(1, 10, 100, False), (2, 20, 100, True), (5, 30, 100, True), (8, 40, 100, False), (9, 50, 100, True)], "n int, covered long, total long, helps boolean")
    assert [tuple(r) for r in benefit.crossings(made).collect()] == [(1, 2, 0.1, 0.2, pytest.approx(0.15)), (8, 9, 0.4, 0.5, pytest.approx(0.45))]


def test_sweep_coverage(blobs):
    candidates = mining.cross_file_candidates(mining.file_patterns(blobs, 6, 24))
    got = {r["min_files"]: r for r in benefit.sweep_coverage(blobs, candidates, (2, 3, 99), n=20).collect()}
    for t in (2, 3, 99):
        chosen = dictionary.mine_across(list(TEXTS.values()), 20, 6, 24, t)
        assert (t in got) == bool(chosen)
        if chosen:
            joined = b"".join(chosen.values())
            share = sum(dictionary.coverage(d, chosen) for d in TEXTS.values()) / (len(TEXTS) + 1)
            want = (len(chosen), pytest.approx(len(joined) / len(chosen)), pytest.approx(entropy(joined)), pytest.approx(share))
            assert tuple(got[t][c] for c in ("n_patterns", "avg_len", "h_pattern", "mean_coverage")) == want
    assert 2 in got


def test_snapshots_by_hash(spark):
    words = {0: b"one", 1: b"two", 130: b"a hundred and thirty"}
    known, other = containers.Snapshot(words), containers.Snapshot({0: b"uno"})
    damaged = bytearray(known.encode())
    damaged[-1] ^= 1
    table = snapshots.snapshot_table(spark.createDataFrame([(known.encode(), 1), (known.encode(), 2), (bytes(damaged), 3), (b"junk", 4), (None, 5)], "content binary, hash int"))
    errors = sorted(str(r["error"]) for r in table.collect())
    assert errors == ["BAD_MAGIC", "HASH_MISMATCH", "None", "None", "None"]
    data = b"one two, a hundred and thirty two one"
    program = dictionary.compress_with_references(data, words)
    keyed = {leb.encode(k): p for k, p in words.items()}
    files = {
        "embedded": containers.ProgramFile(program, dictionary=keyed),
        "external": containers.ProgramFile(program, snapshot=known.hash, deflate=True, urls=["x"]),
        "hybrid": containers.ProgramFile(program, dictionary={leb.encode(0): b"ONE"}, snapshot=known.hash),
        "unpublished": containers.ProgramFile(program, snapshot=other.hash),
        "missing": containers.ProgramFile(program),
    }
    rows = [(name, f.encode(), "clash") for name, f in files.items()] + [("external", files["external"].encode(), "again"), ("junk", b"junk", ""), ("null", None, "")]
    out = snapshots.run_program_files(spark.createDataFrame(rows, "path string, content binary, salt string"), table)
    got = sorted((r["path"], r["source"], r["ok"], r["code"], r["output"] and bytes(r["output"])) for r in out.collect())
    assert got == sorted([
        ("embedded", "EMBEDDED", True, 0, data), ("external", "EXTERNAL", True, 0, data), ("external", "EXTERNAL", True, 0, data),
        ("hybrid", "HYBRID", True, 0, data.replace(b"one", b"ONE")), ("unpublished", "EXTERNAL", False, 9, None), ("missing", "EMBEDDED", False, 7, None),
        ("junk", None, False, 0xFF, None), ("null", None, None, None, None),
    ])
    empty = snapshots.run_program_files(spark.createDataFrame(rows[:2], "path string, content binary, salt string"), table.limit(0))
    assert sorted((r["path"], r["code"]) for r in empty.collect()) == [("embedded", 0), ("external", 9)]


def test_publish_and_delta(spark):
    base = spark.createDataFrame([("k", 0, b"a"), ("k", 7, b"b"), (None, 3, b"c")], "corpus string, rank int, pattern binary")
    delta = spark.createDataFrame([("k", 7, b"A"), ("k", 9, b"d"), (None, 3, b"")], "corpus string, rank int, pattern binary")
    later = snapshots.with_delta(base, delta)
    got = {r["domain"]: containers.Snapshot.decode(bytes(r["content"])) for r in snapshots.publish(later).collect()}
    assert got["k"].patterns == {0: b"a", 7: b"A", 9: b"d"} and got["default"].patterns == {3: b""}
    hashes = {r["corpus"] or "default": r["hash"] for r in mining.snapshot_hash(later).collect()}
    assert hashes == {k: s.hash.hex() for k, s in got.items()}
    statistics = {r["corpus"] or "default": (r["n"], r["avg_len"], r["h_pattern"]) for r in snapshots.snapshot_statistics(later).collect()}
    assert statistics == {k: (s.statistics()["n"], s.statistics()["avg_len"], pytest.approx(s.statistics()["h_pattern"])) for k, s in got.items()}
