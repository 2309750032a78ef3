import random
import time

import pytest

from byteplan.llm import decontaminate as d


def brute_tiles(item, text, least):
    """Greedy tiling by trying every pair of places for the longest match, again and again."""
    free_a, free_b, tiles = [True] * len(item), [True] * len(text), []
    while True:
        best = (0, 0, 0)
        for a in range(len(item)):
            for b in range(len(text)):
                n = 0
                while a + n < len(item) and b + n < len(text) and item[a + n] == text[b + n] and free_a[a + n] and free_b[b + n]:
                    n += 1
                if n > best[0]:
                    best = n, a, b
        n, a, b = best
        if n < least:
            return tiles
        tiles.append((a, b, n))
        free_a[a : a + n], free_b[b : b + n] = [False] * n, [False] * n


def test_tiles():
    rng = random.Random(3)
    for _ in range(200):
        item, text = ([rng.choice("abc") for _ in range(rng.randint(1, n))] for n in (20, 40))
        assert [n for *_, n in d.greedy_tiles(item, text, 3)] == [n for *_, n in brute_tiles(item, text, 3)]
        block = d.ItemBlock([0], [item])
        block.least = [min(3, len(item))]
        assert sorted(n for *_, n in block.tile(0, text)) == sorted(n for *_, n in brute_tiles(item, text, block.least[0]))


WORDS = [f"w{i}" for i in range(60)]
PASSAGE = " ".join(WORDS[:30])


def _tables(spark):
    sentences = [WORDS[i : i + 10] for i in range(0, 30, 10)]
    reordered = "noise " + " ".join(sentences[2]) + ". more noise, " + " ".join(sentences[1]) + "! " + " ".join(sentences[0])
    rows = [
        (1, "before " + PASSAGE + " after"), (2, PASSAGE.upper().replace(" ", "!! ")), (3, reordered), (4, " ".join(WORDS[:12])), (5, " ".join(WORDS[::-1])),
        (6, None), (7, ""), (8, "tiny one here"), (9, "x " * 50_000 + PASSAGE), (1, "before " + PASSAGE + " after"), (None, PASSAGE),
    ]
    docs = spark.createDataFrame([(*r, 1.0, 2) for r in rows], "doc_id long, text string, coverage double, item_id int")
    items = spark.createDataFrame([(10, PASSAGE, 1), (11, "one here", 1), (12, None, 1), (13, " !! ", 1), (10, PASSAGE, 2), (None, " ".join(WORDS[40:]), 1)], "item_id long, text string, doc_id int")
    return docs, items


@pytest.mark.parametrize("block_chars", [d.BLOCK_CHARS, 10])
def test_leaks(spark, block_chars):
    docs, items = _tables(spark)
    got = sorted(str((r["doc_id"], r["item_id"], round(r["coverage"], 3), r["tiles"])) for r in d.find_leaks(docs, items, block_chars=block_chars).collect())
    assert got == sorted(map(str, [(1, 10, 1.0, 1), (1, 10, 1.0, 1), (2, 10, 1.0, 1), (3, 10, 1.0, 3), (8, 11, 1.0, 1), (9, 10, 1.0, 1), (None, 10, 1.0, 1)]))
    kept = d.drop_leaks(docs, items, block_chars=block_chars)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["4", "5", "6", "7"]


def test_empty_tables(spark):
    docs, items = _tables(spark)
    assert d.find_leaks(docs.limit(0), items).count() == 0 and d.find_leaks(docs, items.limit(0)).count() == 0
    assert d.drop_leaks(docs, items.limit(0)).count() == docs.count()
    assert d.find_leaks(docs, items.limit(0)).columns == d.find_leaks(docs, items).columns


def test_against_all_pairs(spark):
    data = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in d.find_leaks(docs, items).collect()}
    texts = {r["doc_id"]: d.tokens(r["text"]) for r in docs.collect()}
    want = set()
    for item in items.collect():
        t = d.tokens(item["text"])
        seeds = {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
        for i, w in texts.items():
            if any(tuple(w[k : k + 5]) in seeds for k in range(len(w) - 4)) and sum(n for *_, n in d.greedy_tiles(t, w, 5)) >= 0.6 * len(t):
                want.add((i, item["item_id"]))
    assert got == want and want


def test_places_of_tiles():
    """Longest first; of equally long ones the earliest in the item, then in the text."""
    rng = random.Random(12)
    for _ in range(200):
        item, text = ([rng.choice("ab") for _ in range(rng.randint(1, n))] for n in (15, 30))
        assert d.greedy_tiles(item, text, 2) == brute_tiles(item, text, 2)


def test_repeated_words_are_cheap():
    """A run of one word against a run of it, and two random texts of two words: linear passes, not all pairs."""
    rng = random.Random(2)
    block = d.ItemBlock([1, 2], [["x"] * 500, [rng.choice("ab") for _ in range(500)]])
    text = "x " * 20_000
    start = time.process_time()
    assert block.coverage(text) == {0: (500, 1)}
    assert time.process_time() - start < 1
    assert 400 < block.coverage(" ".join(rng.choice("ab") for _ in range(20_000)))[1][0] <= 500


def test_hash_collisions_mark_nothing(monkeypatch):
    """All runs of one length have one hash: tokens decide."""
    plain = d._Runs.of
    monkeypatch.setattr(d._Runs, "of", lambda self, n: (plain(self, n)[0], plain(self, n)[1] * d.np.uint64(0)))
    rng = random.Random(5)
    for _ in range(100):
        item, text = ([rng.choice("abc") for _ in range(rng.randint(1, n))] for n in (12, 25))
        assert d.greedy_tiles(item, text, 2) == brute_tiles(item, text, 2)


def test_a_share_leaves_out_only_what_is_below():
    rng = random.Random(7)
    items = [[rng.choice(WORDS) for _ in range(rng.randint(5, 40))] for _ in range(20)]
    block = d.ItemBlock(list(range(20)), items)
    for _ in range(30):
        text = " ".join(w for _ in range(6) for w in rng.choice(items)[rng.randint(0, 10) :][: rng.randint(1, 20)])
        every, some = block.coverage(text), block.coverage(text, 0.6)
        reached = lambda found: {k: v for k, v in found.items() if v[0] >= 0.6 * len(items[k])}
        assert reached(every) == reached(some)
