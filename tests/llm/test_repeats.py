import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest

from byteplan.llm import repeats, suffixes


def brute(rows):
    """rows in order -> (n_bytes, n_removed, n_spans, sha256 of what is left)."""
    seen, out = set(), []
    for t in rows:
        gone = bytearray(len(t))
        for a in range(len(t) - 99):
            w = t[a : a + 100]
            if w in seen:
                gone[a : a + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(1 for k in range(len(t)) if gone[k] and not (k and gone[k - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    rng = random.Random(5)
    base = ["".join(rng.choice("ab ") for _ in range(400)) for _ in range(6)]
    rows = []
    for i in range(60):
        text = ""
        for _ in range(rng.randint(0, 5)):
            a = rng.randint(0, 300)
            text += rng.choice(base)[a : a + rng.randint(50, 260)] + rng.choice(["", "é", "xyz"])
        rows.append((i, text))
    return rows + [(100, "a" * 700), (101, "ab" * 300), (102, None), (103, ""), (104, "a" * 99), (105, "a" * 100), (106, rows[5][1]), (107, "q" * 150)]


@pytest.mark.parametrize(("crowded", "ranges"), [(4096, None), (2, 5), (0, 1)])
def test_removal(spark, crowded, ranges):
    rows = corpus()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = repeats.remove_repeats(frame, ranges=ranges, crowded=crowded).collect()
    assert sorted(tuple(r)[0:4] + (r["kept_sha256"],) for r in got) == [(i, *b) for (i, _), b in zip(rows, brute([(t or "").encode() for _, t in rows]))]
    assert all(hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] for r in got)


def test_odd_tables(spark, docs, texts, nothing):
    got = repeats.remove_repeats(docs).collect()
    assert len(got) == len(texts) and repeats.remove_repeats(nothing).count() == 0
    of = lambda i: [(r["n_bytes"], r["n_removed"]) for r in got if r["doc_id"] == i]
    long = len(texts[60][1])
    assert of(100)[0][1] == 0 and of(101) == [(long, long)] and of(103) == [(0, 0)]
    own = len(texts[3][1])
    assert of(108) == [(own, own * (own >= 100))] * 3
    ordered = [t for t in texts if t[0] is not None and t[0] not in (108, 109)]
    want = dict(zip([t[0] for t in ordered], brute([(t[1] or "").encode() for t in sorted(texts, key=lambda t: (t[0] is None, t[0] or 0)) if t in ordered])))
    assert all(of(t[0]) == [want[t[0]][:2]] for t in ordered)


@pytest.mark.parametrize("alphabet", [b"ab", bytes(range(256))])
def test_windows_against_brute_force(alphabet):
    rng = random.Random(3)
    pool = [bytes(rng.choice(alphabet) for _ in range(300)) for _ in range(3)]
    segments = []
    for _ in range(80):
        a = rng.randint(0, 150)
        segments.append(rng.choice(pool)[a : a + rng.randint(100, 140)])
    found = suffixes.repeated_windows(segments, np.zeros(len(segments), np.uint64), np.arange(len(segments)))
    first = {}
    for k, s in enumerate(segments):
        for i in range(len(s) - 99):
            first.setdefault(s[i : i + 100], k)
    for k, s in enumerate(segments):
        assert found[k].tolist() == [first[s[i : i + 100]] < k for i in range(len(s) - 99)]


def test_windows_are_sorted():
    rng = random.Random(9)
    text = np.frombuffer(bytes(rng.choice(b"ab") for _ in range(60)) * 9 + bytes(400), np.uint8)
    starts = np.arange(0, 500)
    order, classes = suffixes.sort_windows(text, starts)
    windows = [text[s : s + 100].tobytes() for s in starts[order]]
    assert windows == sorted(windows) and all((a == b) == (c == d) for a, b, c, d in zip(windows, windows[1:], classes, classes[1:]))


def test_cover_has_every_difference():
    assert {(a - b) % 31 for a in suffixes.COVER for b in suffixes.COVER} == set(range(31))


def removed_in_process(rows, ranges, crowded, parts=3):
    """The whole plan on Arrow tables, without Spark: rows -> (n_bytes, n_removed, n_spans, sha256)."""
    tables = [
        pa.table({
            "doc_id": pa.array([i for i, _ in own], pa.int64()), "none": pa.array([False] * len(own)), "key": pa.array([hash(t) % 2**40 for _, t in own], pa.int64()),
            "text": pa.array([t for _, t in own], pa.binary()), "bucket": pa.array([b] * len(own), pa.int32()),
        })
        for b, own in enumerate(np.array_split(np.array(rows, dtype=object), ranges)) if len(own)
    ]

    def grouped(found, by):
        whole = pa.concat_tables(found)
        return [whole.filter(pa.compute.equal(whole.column(by), k)) for k in pa.compute.unique(whole.column(by)).to_pylist()]

    answers = pa.concat_tables([repeats._answer(t, crowded) for t in grouped([repeats._anchors(parts, crowded)(t) for t in tables], "part")])
    of = lambda found, b: found.filter(pa.compute.equal(found.column("bucket"), b))
    segments = [repeats._segments(parts)(t, of(answers, b)) for b, t in enumerate(tables)]
    marks = [repeats._sort_suffixes(t) for t in grouped(segments, "part")]
    marks = pa.concat_tables(marks) if marks else pa.table({"bucket": pa.array([], pa.int32()), "marks": pa.array([], pa.binary())})
    told = pa.concat_tables([answers.append_column("marks", pa.nulls(len(answers), pa.binary())), marks.append_column("answers", pa.nulls(len(marks), pa.binary())).select(["bucket", "answers", "marks"])])
    out = pa.concat_tables([repeats._remove(pa.int64())(t, of(told, b)) for b, t in enumerate(tables)]).to_pylist()
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out}


@pytest.mark.parametrize(("ranges", "crowded"), [(1, 4096), (6, 4096), (4, 3), (3, 0)])
@pytest.mark.parametrize("bits", [64, 3, 0])
def test_colliding_hashes_remove_nothing_else(monkeypatch, ranges, crowded, bits):
    """With hashes of a few bits nearly everything collides; what is removed stays the same."""
    mask, inner = np.uint64((1 << bits) - 1), repeats._runs
    monkeypatch.setattr(repeats, "_window_hashes", lambda c, f=repeats._window_hashes: f(c) & mask)
    monkeypatch.setattr(repeats, "_runs", lambda text, at: (*(f := inner(text, at))[:2], f[2] & mask, f[3] & mask))
    rows = [(i, (t or "").encode()) for i, t in corpus()]
    assert removed_in_process(rows, ranges, crowded) == {i: b for (i, _), b in zip(rows, brute([t for _, t in rows]))}


def test_every_hot_anchor_is_split():
    """A range with many contexts of one anchor sends one pair for all of them."""
    texts = [bytes([65 + i % 26, 97 + i // 26]) * 45 + b"the same twenty bytes" + bytes([97 + i % 26]) * 90 for i in range(200)]
    table = pa.table({"text": pa.array(texts, pa.binary()), "bucket": pa.array([7] * 200, pa.int32())})
    pairs = lambda most: np.concatenate([np.frombuffer(b, np.uint64).reshape(-1, 2) for b in repeats._anchors(2, most)(table).column("pairs").to_pylist()])
    most = np.unique(pairs(10_000)[:, 0], return_counts=True)[1].max()
    assert most > 16 and np.unique(pairs(16)[:, 0], return_counts=True)[1].max() <= 16
    assert set(pairs(16)[:, 0]) == set(pairs(10_000)[:, 0])
