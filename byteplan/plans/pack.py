"""Pack, unpack, list, check and profile: jobs over tables of blobs and archives.

An archive here may be many files: every partition of the packed table becomes one, so nothing passes
through a single task. Files are read with Spark's own reader and work in any store it reaches.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.builtin import apply_magic
from ..functions.udfs import functions
from ..kernels import containers, synth
from ..kernels.dictionary import MIN_NET_GAIN, net_gain, strided_patterns
from ..kernels.errors import FormatError, VmError
from ..operators import mining

_K = functions()

#: Fixed value: blobs up to this size are not mined for a dictionary; deflate sees all of them anyway.
MIN_MINED = 32 * 1024


def read_blobs(spark: SparkSession, path: str, corpus: str = "all") -> DataFrame:
    """All files under a folder as blobs, paths relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    relative = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/+", "/"), "^.*?" + path.rstrip("/").split("://")[-1].replace(".", r"\.") + "/", "")
    return files.select(F.lit(corpus).alias("corpus"), relative.alias("path"), "content", F.col("length").cast("bigint").alias("length"))


def mine_dictionary(blobs: DataFrame, min_size: int = MIN_MINED) -> dict[bytes, bytes]:
    """A dictionary of what programs leave literal in large blobs; empty unless it promises a net gain.

    Literals are mined one by one, so no pattern reaches over two of them. A blob's program is made once, and only its
    patterns leave the kernel. At most 50 patterns come to the driver.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                pieces = synth.compress(data.as_py()).program.literals()
                if not pieces:  # blobs that are all structure do not count
                    continue
                found = [None, *set().union(*map(strided_patterns, pieces))]  # null: the blob
                del pieces
                for at in range(0, len(found), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(found[at : at + 10_000], pa.binary())], names=["pattern"])

    large = blobs.filter(F.col("length") > min_size)
    counts = large.select("content").mapInArrow(run, "pattern binary").groupBy("pattern").agg(F.count("*").alias("files")).persist(StorageLevel.DISK_ONLY)
    try:
        seen = counts.filter("pattern IS NULL").select(F.lit("all").alias("corpus"), F.col("files").alias("seen"))
        rows = mining.ranked_dictionary(counts.filter("pattern IS NOT NULL").select(F.lit("all").alias("corpus"), "pattern", "files"), seen).collect()
    finally:
        counts.unpersist()
    found = {bytes(r["key"]): bytes(r["pattern"]) for r in rows}
    return found if rows and net_gain(found, rows[0]["seen"]) >= MIN_NET_GAIN else {}


def encode_entries(
    blobs: DataFrame, dictionary: Mapping[bytes, bytes] | None = None, force_programs: bool = False, max_memory: int = containers.MAX_MEMORY
) -> DataFrame:
    """Blobs as archive entries: path, method, original_size, compressed_size, payload.

    Blobs over ``max_memory`` and those that begin like a compressed format are stored without going
    through a kernel.
    """
    stored = (F.col("length") > max_memory) | apply_magic(F.col("content"))
    sizes = [F.col("length").alias("original_size"), F.octet_length("payload").cast("bigint").alias("compressed_size"), "payload"]
    plain = blobs.filter(stored).select("path", F.lit("store").alias("method"), "length", F.col("content").alias("payload"))
    entry = _K["encode_entry"]("content", _pairs(dictionary), F.lit(force_programs))
    rest = blobs.filter(~stored).select("path", "length", entry.alias("e")).select("path", "e.method", "length", "e.payload")
    return plain.unionByName(rest).select("path", "method", *sizes)


def decode_entries(entries: DataFrame, dictionary: Mapping[bytes, bytes] | None = None) -> DataFrame:
    """Archive entries as blobs."""
    content = _K["decode_entry"]("method", "payload", _pairs(dictionary))
    return entries.select("path", content.alias("content")).withColumn("length", F.octet_length("content").cast("bigint"))


def _pairs(dictionary: Mapping[bytes, bytes] | None):
    if not dictionary:
        return F.lit(None).cast("array<struct<key:binary,pattern:binary>>")
    pair = lambda k, p: F.struct(F.lit(k).alias("key"), F.lit(p).alias("pattern"))
    return F.array(*[pair(k, p) for k, p in sorted(dictionary.items())])


def archives(entries: DataFrame, dictionary: Mapping[bytes, bytes] | None = None, shard_bytes: int = 128 << 20) -> DataFrame:
    """Entries packed into archives of about ``shard_bytes``, one or more per partition: (first_path, n, data)."""
    dictionary = dict(dictionary or {})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                shard.append((row["path"], row["method"], row["original_size"], row["payload"]))
                size += len(row["payload"])
                if size >= shard_bytes:
                    yield close(shard)
                    shard, size = [], 0
        if shard:
            yield close(shard)

    def close(shard: list) -> pa.RecordBatch:
        data = containers.write_archive(shard, dictionary)
        return pa.RecordBatch.from_arrays([pa.array([shard[0][0]]), pa.array([len(shard)], pa.int64()), pa.array([data], pa.binary())], names=["first_path", "n", "data"])

    # Paths are ordered by their components, as a walk through sorted folders meets them.
    ordered = entries.sortWithinPartitions(F.split("path", "/"))
    return ordered.mapInArrow(run, "first_path string, n long, data binary")


def pack(blobs: DataFrame, path: str, deep: bool = False, max_memory: int = containers.MAX_MEMORY) -> None:
    """Write blobs as archives under ``path``; ``deep`` mines a dictionary first."""
    from ..sources.archive import write_files

    dictionary = mine_dictionary(blobs) if deep else None
    write_files(archives(encode_entries(blobs, dictionary, deep, max_memory), dictionary), path)


def archive_entries(files: DataFrame, with_content: bool = False) -> DataFrame:
    """(path, content) archive files -> one row per entry; payloads are decoded only if asked for."""
    extra = ", content binary, ok boolean" if with_content else ""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                data = data.as_buffer().to_pybytes()
                entries, dictionary = containers.read_index(data)
                for at in range(0, len(entries), 64):
                    part = entries[at : at + 64]
                    columns = {
                        "archive": [name] * len(part), "path": [e.path for e in part], "method": [e.method for e in part],
                        "original_size": [e.original_size for e in part], "compressed_size": [e.compressed_size for e in part],
                    }
                    if with_content:
                        columns["content"] = [_decode(e, data, dictionary) for e in part]
                        columns["ok"] = [c is not None and len(c) == e.original_size for c, e in zip(columns["content"], part)]
                    types = [pa.string()] * 3 + [pa.int64()] * 2 + [pa.binary(), pa.bool_()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns.values(), types)], names=list(columns))

    return files.select("path", "content").mapInArrow(run, f"archive string, path string, method string, original_size long, compressed_size long{extra}")


def _decode(e: containers.Entry, data: bytes, dictionary: Mapping[bytes, bytes]) -> bytes | None:
    try:
        return containers.decode_entry(e.method, data[e.offset : e.offset + e.compressed_size], dictionary)
    except (FormatError, VmError):
        return None


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.archive").option("recursiveFileLookup", "true").load(path)


def list_archive(spark: SparkSession, path: str) -> DataFrame:
    """Metadata of all entries under ``path``."""
    return archive_entries(_files(spark, path))


def summary(entries: DataFrame) -> DataFrame:
    """Entries and sizes per method, and in total (method null)."""
    sums = entries.rollup("method").agg(
        F.count("*").alias("n"), F.sum("original_size").alias("original_size"), F.sum("compressed_size").alias("compressed_size")
    )
    ratio = F.when(F.col("original_size") > 0, F.col("compressed_size") / F.col("original_size")).otherwise(1.0)
    return sums.withColumn("ratio", ratio)


def unpack(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of all entries; unsafe paths and damaged entries are errors."""
    rows = archive_entries(_files(spark, path), with_content=True)
    good = F.col("ok") & _K["safe_path"]("path")
    return rows.select("path", F.when(good, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("cannot unpack "), "path"))).alias("content"))


def check(spark: SparkSession, path: str) -> DataFrame:
    """Entries that decode, and that do not, per archive."""
    rows = archive_entries(_files(spark, path), with_content=True)
    return rows.groupBy("archive").agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("n_failed"))


def bench(blobs: DataFrame) -> DataFrame:
    """Class, sizes by each way of encoding and by general codecs, and whether the blob comes back, for each blob."""
    rows = blobs.withColumn("s", _K["synthesize"]("content")).withColumn("blob", _K["encode_blob"]("content"))
    rows = rows.withColumn("c", _K["codec_sizes"]("content"))
    return rows.select(
        "path", "length", "s.data_class", "s.structure_first", "s.lz_ratio", F.col("s.ratio").alias("synth_ratio"),
        (F.col("s.lz_ratio") - F.col("s.ratio")).alias("gain"), F.octet_length("blob").cast("bigint").alias("blob_size"),
        "c.*", (_K["decode_blob"]("blob") == F.col("content")).alias("round_trip"),
    )
