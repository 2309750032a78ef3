import pytest
from pyspark.sql import functions as F

from byteplan import functions, sources
from byteplan.kernels import containers, dictionary
from byteplan.operators import mining
from byteplan.plans import pack
from byteplan.schema import BLOBS

LOG = b"".join(b"2024-01-01 00:00:%02d host-%d app: request /api/v1/items/%d took %d ms\n" % (i % 60, i % 3, i, i * 7 % 100) for i in range(900))


@pytest.fixture(scope="module")
def blobs(spark):
    data = [(f"logs/{i}.txt", LOG[i * 20 :]) for i in range(6)] + [("a/empty", b""), ("a/jpeg", b"\xff\xd8\xff\xe0" + b"\xab" * 300), ("z.bin", bytes(range(256)) * 4)]
    return spark.createDataFrame([("all", p, d, len(d)) for p, d in data], BLOBS)


@pytest.mark.parametrize("deep", [False, True])
def test_pack_unpack_check_list(spark, blobs, tmp_path, deep):
    out = str(tmp_path / "packed")
    pack.pack(blobs.coalesce(2), out, deep=deep)
    want = {r["path"]: bytes(r["content"]) for r in blobs.collect()}
    assert {r["path"]: bytes(r["content"]) for r in pack.unpack(spark, out).collect()} == want
    listed = pack.list_archive(spark, out)
    assert {r["path"]: r["original_size"] for r in listed.collect()} == {p: len(d) for p, d in want.items()}
    assert pack.check(spark, out).agg(F.sum("n"), F.sum("n_failed")).first() == (9, 0)
    total = pack.summary(listed).filter("method IS NULL").first()
    assert total["n"] == 9 and total["ratio"] < (0.35 if deep else 0.5)


def test_data_source(spark, blobs, tmp_path):
    sources.register(spark)
    out = str(tmp_path / "source")
    blobs.select("path", "content").coalesce(2).write.format("byteplan-archive").mode("append").save(out)
    read = spark.read.format("byteplan-archive").option("partitionBytes", "5000").load(out)
    assert read.rdd.getNumPartitions() > 2
    assert {r["path"]: bytes(r["content"]) for r in read.collect()} == {r["path"]: bytes(r["content"]) for r in blobs.collect()}
    bare = spark.read.format("byteplan-archive").option("metadataOnly", "true").load(out)
    assert bare.filter("content IS NOT NULL").count() == 0 and bare.agg(F.sum("original_size")).first()[0] == blobs.agg(F.sum("length")).first()[0]


def test_directory_of_files(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "x.txt").write_bytes(b"one")
    (tmp_path / "d" / "e" / "y.txt").write_bytes(b"two")
    rows = pack.read_blobs(spark, str(tmp_path / "d")).collect()
    assert {r["path"]: bytes(r["content"]) for r in rows} == {"x.txt": b"one", "e/y.txt": b"two"}


def test_unsafe_and_damaged_archives(spark, tmp_path):
    (tmp_path / "bad.archive").write_bytes(containers.write_archive([("../x", "store", 1, b"a")]))
    with pytest.raises(Exception, match="cannot unpack"):
        pack.unpack(spark, str(tmp_path)).collect()
    (tmp_path / "bad.archive").write_bytes(containers.write_archive([("x", "zlib", 1, b"junk"), ("y", "store", 1, b"a")]))
    assert pack.check(spark, str(tmp_path)).select("n", "n_failed").first() == (2, 1)


def test_mining_agrees_with_the_kernels(spark, blobs):
    data = [bytes(r["content"]) for r in blobs.collect()]
    found = mining.strided_dictionary(blobs)
    assert {bytes(r["key"]): bytes(r["pattern"]) for r in found.collect()} == dictionary.mine_strided(data)
    gain = mining.net_gain(found).first()["gain"]
    assert gain == dictionary.net_gain(dictionary.mine_strided(data), sum(map(bool, data)))
    short = blobs.withColumn("content", F.substring("content", 1, 700))
    candidates = mining.cross_file_candidates(mining.file_patterns(short, 6, 20))
    want = dictionary.mine_across([d[:700] for d in data], n=10, longest=20)
    assert mining.select_patterns(candidates, 10) == list(want.values())
    snapshot = containers.Snapshot(want)
    numbered = spark.createDataFrame([("c", k, p) for k, p in want.items()], "corpus string, rank int, pattern binary")
    assert mining.snapshot_hash(numbered).first()["hash"] == snapshot.hash.hex()
    for row in mining.leave_one_out(short.filter("path LIKE 'logs%'"), n=10, longest=12).collect():
        others = [bytes(r["content"])[:700] for r in blobs.filter("path LIKE 'logs%'").collect() if r["path"] != row["path"]]
        assert row["n_patterns"] == len(dictionary.mine_across(others, n=10, longest=12))


def test_kernels_in_sql_and_nulls(spark):
    functions.register(spark)
    row = spark.sql("SELECT run_program(compress_naive(CAST('abcabcabcabc' AS BINARY))) AS a, byte_entropy(CAST(NULL AS BINARY)) AS b, try_run_program(X'AB').code AS c").first()
    assert bytes(row["a"]) == b"abcabcabcabc" and row["b"] is None and row["c"] == 1


def test_streams(spark, blobs, tmp_path):
    from byteplan.streaming import pack_stream, pattern_counts

    blobs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(BLOBS).parquet(str(tmp_path / "in"))
    query = pack_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination()
    assert {r["path"] for r in pack.unpack(spark, str(tmp_path / "out")).collect()} == {r["path"] for r in blobs.collect()}
    query = pattern_counts(stream, 16).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck2")).start()
    query.processAllAvailable()
    query.stop()
    want = mining.strided_counts(blobs, (16,)).select("pattern", "files")
    assert spark.table("counts").exceptAll(want).count() == 0 and want.count() == spark.table("counts").count()


def test_command_line(spark, tmp_path, capsys):
    from byteplan.__main__ import main

    folder = tmp_path / "in"
    (folder / "sub").mkdir(parents=True)
    (folder / "sub" / "log.txt").write_bytes(LOG)
    (folder / "x").write_bytes(b"tiny")
    main(["pack", str(folder), "-o", str(tmp_path / "packed"), "--deep", "--max-memory", "100000"])
    main(["list", str(tmp_path / "packed")])
    assert "KB" in capsys.readouterr().out
    main(["check", str(tmp_path / "packed")])
    main(["unpack", str(tmp_path / "packed"), "-o", str(tmp_path / "out")])
    assert (tmp_path / "out" / "sub" / "log.txt").read_bytes() == LOG and (tmp_path / "out" / "x").read_bytes() == b"tiny"
    main(["compress", str(folder / "x"), "-o", str(tmp_path / "x.blob")])
    main(["decompress", str(tmp_path / "x.blob"), "-o", str(tmp_path / "x.back")])
    assert (tmp_path / "x.back").read_bytes() == b"tiny"
    main(["bench", str(folder)])
