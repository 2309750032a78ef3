import re

import numpy as np
import pytest
import xxhash

from byteplan.llm import components, simhash


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def groups(values, radius=2):
    """Index -> group, by comparing all pairs."""
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= radius:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(values))]


def test_fingerprints(texts):
    for _, t, _, _ in texts:
        assert simhash.fingerprint(t) == brute_fingerprint(t)
    many = "word " * 70000  # more than one block of hashes
    assert simhash.fingerprint(many) == brute_fingerprint(many)


def test_components(spark, docs, texts, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = simhash.op5_simhash(spark, str(tmp_path)).collect()
    values = [brute_fingerprint(t) for _, t, _, _ in texts]
    least = {}
    for g, (i, _, _, _) in zip(groups(values), texts):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    want = sorted((str(i), f"{v:016x}", str(least.get(g))) for v, g, (i, _, _, _) in zip(values, groups(values), texts))
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == want


@pytest.mark.parametrize("cell", [64, 2, 0])
def test_links_connect_exactly_the_near(spark, cell):
    rng = np.random.default_rng(5)
    centers = rng.integers(0, 2**63, 12, dtype=np.uint64)
    values = {0, 2**64 - 1}
    for c in centers.tolist():
        for _ in range(25):
            v = c
            for b in rng.integers(0, 64, rng.integers(0, 5)).tolist():
                v ^= 1 << b
            values.add(v)
    values = sorted(values)
    frame = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    links = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.near_links(frame, cell=cell).collect()]
    assert all(bin(a ^ b).count("1") <= 2 for a, b in links)
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    for (v, g), (w, h) in zip(zip(values, groups(values)), zip(values[1:], groups(values)[1:])):
        assert (find(v) == find(w)) == (g == h)
    if cell < 64:
        assert len(links) < 66 * len(values)


def test_pivot_distances_bound_the_hamming_distance(spark):
    frame = spark.createDataFrame([(simhash._signed(v),) for v in (0, 1, 3, 2**63)], "fp long")
    rows = {r["fp"]: r for r in simhash.pivot_table(frame).collect()}
    assert all(abs(x - y) <= 2 for x, y in zip(rows[0]["far"], rows[3]["far"]))
    shared = [a["cell"] == b["cell"] for a, b in zip(rows[0]["cells"], rows[3]["cells"])]
    assert shared == [False, True, True]


def test_connected_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (1, 0)] + [(200, 200 + i) for i in range(1, 60)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100, **dict.fromkeys(range(200, 260), 200)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_document_of_each_group_stays(spark, docs, texts, nothing):
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    values = [brute_fingerprint(t) for _, t, _, _ in texts]
    assert kept.count() == len(set(groups(values)))
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert 3 in ids and 108 not in ids and ids.count(109) == 2
    assert simhash.drop_near_duplicates(nothing).count() == 0


def test_bands_cut_all_bits_at_every_level():
    for level in range(simhash.LEVELS):
        bands = simhash._bands(level)
        assert sum(bands) == 2**64 - 1 and bands[0] & bands[1] == bands[0] & bands[2] == bands[1] & bands[2] == 0
    agreed = {0}
    for level in range(simhash.LEVELS):
        agreed = {a | b for a in agreed for b in simhash._bands(level)}
    assert max(64 - bin(a).count("1") for a in agreed) <= 12


@pytest.mark.parametrize("cell", [64, 3])
def test_crowded_cells_keep_every_link(spark, cell):
    """All 1,024 values of ten bits, a chain of steps of two bits, and a cluster of which only some are near."""
    rng = np.random.default_rng(8)
    cube = [0x123456789ABCDEF0 ^ sum(1 << (6 * j) for j in range(10) if i >> j & 1) for i in range(1024)]
    chain = [0]
    for k in range(0, 62, 2):
        chain.append(chain[-1] ^ (3 << k))
    center = int(rng.integers(0, 2**63))
    loose = [center ^ sum(1 << int(b) for b in rng.choice(64, 3, replace=False)) for _ in range(300)]
    values = sorted({*cube, *chain, *loose})
    frame = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    got = {tuple(sorted((r["a"] % 2**64, r["b"] % 2**64))) for r in simhash.near_links(frame, cell=cell).collect()}
    array = np.array(values, dtype=np.uint64)
    want = set()
    for i, v in enumerate(values):
        near = np.bitwise_count(array[i + 1 :] ^ np.uint64(v)) <= 2
        want |= {(v, int(w)) for w in array[i + 1 :][near]}
    assert got == want and len(want) > 28_000


def test_equal_ids_and_texts_keep_the_same_row(spark):
    rows = [(1, "same words here", lang, source) for lang in ("en", "de", None) for source in ("a", "b", None)] * 3
    kept = [simhash.drop_near_duplicates(spark.createDataFrame(rows[k:] + rows[:k], "doc_id long, text string, lang string, source string")).collect() for k in (0, 4, 17)]
    assert len(kept[0]) == 1 and kept[0] == kept[1] == kept[2]
