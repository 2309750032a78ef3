"""Data sources: ranges of archives, the check at the commit, files of one thing each."""

import json
import os

import pytest

from byteplan import sources
from byteplan.kernels import containers, dictionary, leb
from byteplan.kernels.errors import FormatError
from byteplan.operators import snapshots
from byteplan.sources import archive

DATA = {f"d/{i:02d}": b"line %d of a text; " % i * (i * i) for i in range(40)} | {"nothing": b"", "random": bytes(range(256)) * 3, "z": b""}


@pytest.fixture(scope="module")
def rows(spark):
    sources.register(spark)
    return spark.createDataFrame([(p, d, "more") for p, d in DATA.items()], "path string, content binary, method string")


@pytest.mark.parametrize("share", [1, 700, 64 << 20])
@pytest.mark.parametrize("most", [0, 10**6])
def test_ranges_give_every_entry_once(tmp_path, monkeypatch, share, most):
    monkeypatch.setattr(archive, "MOST_RANGES", most)
    words = {b"\x00": b"line", b"\x01": b" of a text; "}
    frames = [(p, m, len(d), body) for p, d in DATA.items() for m, body in [containers.encode_entry(d, words, force_programs=True)]]
    (tmp_path / "one.archive").write_bytes(containers.write_archive(frames, words))
    (tmp_path / "none.archive").write_bytes(containers.write_archive([]))
    reader = archive._Reader({"path": str(tmp_path), "partitionBytes": str(share)})
    got = [row for part in reader.partitions() for row in reader.read(part)]
    assert sorted((r[0], r[4]) for r in got) == sorted(DATA.items())
    (tmp_path / "one.archive").write_bytes(containers.write_archive(frames, words) + b"x")
    with pytest.raises(FormatError, match="COUNT_MISMATCH"):
        [row for part in reader.partitions() for row in reader.read(part)]


def test_shards_commit_and_overwrite(spark, rows, tmp_path):
    out = str(tmp_path / "a")
    rows.coalesce(1).write.format("byteplan-archive").mode("append").option("shardBytes", "300").save(out)
    files = [f for f in os.listdir(out) if f.endswith(".archive")]
    told = json.loads((tmp_path / "a" / "_written.json").read_text())
    assert len(files) > 3 and told == {"archives": len(files), "entries": len(DATA), "size": sum(os.path.getsize(f"{out}/{f}") for f in files), "original_size": sum(map(len, DATA.values()))}
    back = spark.read.format("byteplan-archive").load(out)
    assert sorted((r["path"], bytes(r["content"])) for r in back.collect()) == sorted(DATA.items())
    rows.limit(3).write.format("byteplan-archive").mode("overwrite").save(out)
    assert spark.read.format("byteplan-archive").load(out).count() == 3
    rows.limit(0).write.format("byteplan-archive").mode("overwrite").save(out)
    assert spark.read.format("byteplan-archive").load(out).count() == 0


def test_commit_finds_what_is_missing(tmp_path):
    writer = archive._Writer({"path": str(tmp_path)})
    message = writer.write(iter([{"path": "x", "content": b"abc"}, {"path": "y", "content": b""}]))
    writer.commit([message, None])
    file = message.files[0][0]
    whole = open(file, "rb").read()
    for damaged in (whole[:-1], whole[:6] + b"\x07" + whole[7:]):
        open(file, "wb").write(damaged)
        with pytest.raises(FormatError, match="COUNT_MISMATCH"):
            writer.commit([message])
    writer.abort([message, None])
    assert not os.path.exists(file)


def test_blobs(spark, rows, tmp_path):
    out = str(tmp_path / "b")
    rows.repartition(3).write.format("byteplan-blob").mode("append").save(out)
    got = spark.read.format("byteplan-blob").option("partitionBytes", "100").load(out)
    assert {r["path"]: (bytes(r["content"]), r["length"]) for r in got.collect()} == {p: (d, len(d)) for p, d in DATA.items()}
    assert got.rdd.getNumPartitions() > 2
    one = spark.read.format("byteplan-blob").load(f"{out}/d/07.blob").first()
    assert (one["path"], bytes(one["content"]), one["stored_size"]) == ("07", DATA["d/07"], os.path.getsize(f"{out}/d/07.blob"))
    with pytest.raises(Exception, match="BAD_PATH"):
        spark.createDataFrame([("../x", b"a")], "path string, content binary").write.format("byteplan-blob").mode("append").save(out)


def test_programs_and_snapshots(spark, rows, tmp_path):
    words = {0: b"line", 1: b" of a text; "}
    known = containers.Snapshot(words, "texts", (2, 3))
    spark.createDataFrame([("texts/2.3", known.encode())], "path string, content binary").write.format("byteplan-snapshot").mode("append").save(str(tmp_path / "s"))
    files = [(p, containers.ProgramFile(dictionary.compress_with_references(d, words), dictionary={leb.encode(0): b"line"}, snapshot=known.hash).encode()) for p, d in DATA.items()]
    spark.createDataFrame(files, "path string, content binary").write.format("byteplan-program").mode("append").save(str(tmp_path / "p"))
    published = spark.read.format("byteplan-snapshot").load(str(tmp_path / "s"))
    assert published.select("path", "hash", "domain", "version", "n_patterns").collect() == [("texts/2.3", known.hash.hex(), "texts", "2.3", 2)]
    programs = spark.read.format("byteplan-program").load(str(tmp_path / "p"))
    assert {(r["source"], r["snapshot"], r["n_patterns"]) for r in programs.collect()} == {("HYBRID", known.hash.hex(), 1)}
    out = snapshots.run_program_files(programs, snapshots.snapshot_table(published))
    assert {r["path"]: bytes(r["output"]) for r in out.collect()} == DATA
    with pytest.raises(Exception, match="HASH_MISMATCH"):
        bad = spark.createDataFrame([("x", known.encode()[:-1] + b"!")], "path string, content binary")
        bad.write.format("byteplan-snapshot").mode("append").save(str(tmp_path / "s"))
