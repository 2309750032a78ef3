import hashlib

import numpy as np
import pytest

from byteplan.llm import fingerprints as fp


def test_edited_texts_and_order(spark, docs, texts, nothing):
    got = fp.fingerprint_neighbours(docs, ranges=5).collect()
    assert len(got) == len(texts) and fp.fingerprint_neighbours(nothing).count() == 0
    unique = [t for t in texts if t[0] is not None and t[0] < 100]
    order = sorted(unique, key=lambda t: -t[0])
    by_id = {r["doc_id"]: r for r in got}
    for (i, t, _, _), (_, nxt, _, _) in zip(order, order[1:]):
        n, k = len(t), len(t) // 3
        edited = t[: n - k] + nxt[:k]
        assert by_id[i]["n_chars"] == n and by_id[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert by_id[i]["fingerprint"] == fp.as_hex(fp.order_minhash(t)) and by_id[i]["edited_fingerprint"] == fp.as_hex(fp.order_minhash(edited))
        assert by_id[i]["near_next"] == fp.likeness(fp.order_minhash(t), fp.order_minhash(nxt))
    assert by_id[101]["near_next"] == 1.0  # its next one is a copy


@pytest.mark.parametrize("ranges", [1, 3, 64])
def test_ring_over_ranges(spark, ranges):
    rows = [(i * 7, f"text number {i} of some length " * (1 + i % 4)) for i in range(50)]
    got = {r["doc_id"]: r["edited_sha256"] for r in fp.fingerprint_neighbours(spark.createDataFrame(rows, "doc_id long, text string"), ranges=ranges).collect()}
    rows = rows[::-1]
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        assert got[i] == hashlib.sha256((t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]).encode()).hexdigest()
    one = fp.fingerprint_neighbours(spark.createDataFrame(rows[:1], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0


@pytest.mark.parametrize("ranges", [1, 6])
def test_order_of_null_and_repeated_ids(spark, ranges):
    """Descending ids, null last; equal ids by a hash of their text; equal rows one after another."""
    texts = [f"some text {i} " * (i % 3 + 1) for i in range(12)]
    rows = [(5, texts[0]), (5, texts[1]), (5, texts[2]), (7, texts[3]), (7, texts[3]), (7, texts[3]), (None, texts[4]), (None, texts[5]), (None, texts[5]), (9, None), (9, ""), (1, texts[6])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    keys = {r["t"]: r["k"] for r in frame.selectExpr("coalesce(text, '') AS t", "xxhash64(coalesce(text, '')) AS k").collect()}
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), keys[r[1]]))
    if ranges > 1:  # null ids are spread by their key, so only their share of the ring is known
        order = [r for r in order if r[0] is not None]
    edit = lambda t, n: hashlib.sha256((t[: len(t) - len(t) // 3] + n[: len(t) // 3]).encode()).hexdigest()
    got = fp.fingerprint_neighbours(frame, ranges=ranges).collect()
    assert len(got) == len(rows)
    want = [(str(i), fp.as_hex(fp.order_minhash(t)), edit(t, order[(k + 1) % len(order)][1])) for k, (i, t) in enumerate(order)]
    have = [(str(r["doc_id"]), r["fingerprint"], r["edited_sha256"]) for r in got]
    assert sorted(want) == sorted(have) if ranges == 1 else not set(want[:-1]) - set(have)


def slow(text):
    """Order MinHash with sorting for every function."""
    x = fp.kmers(text)
    if not len(x):
        return np.zeros(fp.SIGNATURES, np.uint32)
    seen, occurrence = {}, []
    for v in x.tolist():
        occurrence.append(seen.get(v, 0))
        seen[v] = occurrence[-1] + 1
    numbered = (fp._mix(x + np.array(occurrence, np.uint64) * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(32)).astype(np.uint32)
    out = []
    for a, b in zip(fp._A, fp._B):
        h = (numbered ^ b) * a
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        places = sorted(sorted(range(len(x)), key=lambda i: (int(h[i]), i))[: fp.PICK])
        value = np.array([len(places)], np.uint64)
        for p in places:
            value = fp._mix(value * np.uint64(0x9FB21C651E98DF25) + x[p])
        out.append(int(value[0] >> np.uint64(32)))
    return np.array(out, np.uint32)


def test_signatures(texts):
    for t in ["", "a", "abcdefg", "abcdefgh", "abcdefghi", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"] + [t for _, t, _, _ in texts[:20]]:
        assert (fp.order_minhash(t) == slow(t)).all()


def test_order_matters_and_edits_show():
    a = " ".join(f"word{i}" for i in range(400))
    parts = a.split()
    swapped = " ".join(parts[200:] + parts[:200])
    edited = a.replace("word7 ", "other ")
    one = fp.order_minhash(a)
    assert fp.likeness(one, fp.order_minhash(edited)) > 0.85 > fp.likeness(one, fp.order_minhash(swapped)) > 0
    assert fp.likeness(one, fp.order_minhash("b" * 500)) == 0
