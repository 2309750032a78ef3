"""Queries that have no SQL for the whole of their input, against brute force."""

import duckdb
import pytest

from byteplan import queries as Q
from byteplan.kernels import dictionary
from byteplan.operators import mining

DATA = "/root/testdata/sf0.01"


def expected(blobs, path, **lengths):
    chosen = dictionary.mine_across([b for p, b in blobs.items() if p != path], **lengths)
    found = dictionary.predict_benefit(blobs[path], chosen)
    return len(chosen), found["h_pattern"], found["coverage"], found["predicts_benefit"]


def answer(row):
    return row["n_patterns"], row["h_pattern"], row["coverage"], row["predicts_benefit"]


def test_leave_one_out_reads_whole_blobs(spark):
    sql = f"""SELECT (o_custkey % 20)::VARCHAR, string_agg(o_orderkey || ',fixed,' || o_orderstatus || ',' || o_custkey || chr(10), '' ORDER BY o_orderkey)
      FROM read_parquet('{DATA}/orders.parquet') GROUP BY 1"""
    blobs = {p: t.encode() for p, t in duckdb.sql(sql).fetchall()}
    got = {r["path"]: answer(r) for r in Q.queries()["leave_one_out"](spark, DATA).collect()}
    assert set(got) == set(blobs) and min(map(len, blobs.values())) > 1500
    for path in ("0", "7", "19"):
        assert got[path] == pytest.approx(expected(blobs, path))


def test_leave_one_out_on_odd_blobs(spark):
    blobs = {"a": b"the first of them; " * 9, "b": b"the first of them, " * 7 + b"x", "c": b"of them; of them; the first; the first", "d": b"", "e": b"\x00\xff" * 40}
    rows = spark.createDataFrame([("k", p, b, len(b)) for p, b in blobs.items()] + [(None, "a", b"alone alone alone ", 18)], "corpus string, path string, content binary, length long")
    got = sorted(((r["path"], *answer(r)) for r in mining.leave_one_out(rows, n=5).collect()), key=repr)
    want = [(p, *expected(blobs, p, n=5)) for p in blobs] + [("a", 0, 0.0, 0.0, False)]
    assert got == sorted(want, key=repr)


def best_gain(data):
    """The gain of the best macro of 8 to 64 bytes, trying every one."""
    best = 0
    for w in range(8, min(64, len(data) // 2) + 1):
        for pattern in {data[i : i + w] for i in range(len(data) - w + 1)}:
            uses = data.count(pattern)
            best = max(best, uses * w - w - 6 if uses >= 2 else 0)
    return best


def test_best_macros_of_every_item(spark, tmp_path):
    late = "".join(chr(0x4E00 + i) for i in range(350)) + "späte Wiederholung " * 3  # repeats after byte 1,000
    texts = ["Grüße aus Köln, Grüße aus Köln", "日本語のテキスト" * 5, "é" * 40, "ascii only, ascii only, ascii only", "kurz é", "", None, "\x00\x01ÿ\x00\x01ÿ\x00\x01ÿ" * 4, late]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["item_id"]: r["gain"] for r in Q.queries()["best_macros_bytes"](spark, str(tmp_path)).collect()}
    assert got == {i: best_gain((t or "").encode()) for i, t in enumerate(texts)}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM read_parquet('{tmp_path}/benchmark.parquet/*.parquet')")
    assert dict(con.execute(Q.oracle_sql()["best_macros_bytes"]).fetchall()) == got


def test_best_macros_leave_no_item_out(spark):
    rows = Q.queries()["best_macros_bytes"](spark, DATA).collect()
    items = duckdb.sql(f"SELECT item_id FROM read_parquet('{DATA}/benchmark.parquet')").fetchall()
    assert sorted(r["item_id"] for r in rows) == sorted(i for i, in items)


def test_cross_file_queries_take_long_patterns(spark, tmp_path):
    phrase = "a phrase of more than twelve bytes; "
    texts = [phrase * 3 + "one", "two " + phrase * 2, (phrase + "three ") * 2, "alone"]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    blobs = [t.encode() for t in texts]
    want = [p.hex().upper() for p in dictionary.mine_across(blobs).values()]
    rows = Q.queries()["cross_file_dictionary"](spark, str(tmp_path)).orderBy("rank").collect()
    assert [r["pattern"] for r in rows] == want and max(map(len, want)) > 2 * 12
    found = Q.queries()["cross_file_candidates"](spark, str(tmp_path)).collect()
    assert {len(r["pattern"]) // 2 for r in found} >= set(range(6, 37))
    sweep = {r["min_files"]: r["n_patterns"] for r in Q.queries()["pattern_sweep"](spark, str(tmp_path)).collect()}
    assert sweep == {t: n for t in (2, 3, 5) if (n := sum(r["files"] >= t for r in found))}
