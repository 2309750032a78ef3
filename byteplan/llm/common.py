"""Shared helpers of the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: The ASCII white space that separates words everywhere in this subpackage.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark only (the path may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, ``spark.checkpoint.dir``.

    Where the session names none, a master in one process (``local[...]``: tests, a laptop) gets a temporary folder
    of its own, as driver and executor are one machine there. A cluster without the setting is an error: every
    executor would write to its own disk.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[context.applicationId] = tempfile.mkdtemp(prefix="byteplan-")
    return _LOCAL_DIRS[context.applicationId]


_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Shuffle files go as soon as the table they were for is written.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a compressed Parquet table in the shared folder.

    Unlike an executor-local cache or checkpoint, the table survives lost executors, and
    unlike ``checkpoint()`` it is columnar and compressed.
    """
    return materialize_all([df])


def materialize_all(frames: Iterable[DataFrame]) -> DataFrame:
    """One table of the rows of several frames of one schema (one frame at least), written one after another."""
    paths: list[str] = []
    for df in frames:
        spark, schema = df.sparkSession, df.schema
        paths.append(f"{shared_dir(spark)}/byteplan-{uuid.uuid4().hex}")
        before = spark.conf.get(_FREE_SHUFFLES, None)
        spark.conf.set(_FREE_SHUFFLES, "true")
        try:
            df.write.parquet(paths[-1])
        finally:
            if before is None:
                spark.conf.unset(_FREE_SHUFFLES)
            else:
                spark.conf.set(_FREE_SHUFFLES, before)
    return spark.read.schema(schema).parquet(*paths)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let the session hand at most so many rows at a time to Python: batches of long texts take memory on both sides."""
    if int(spark.conf.get(_BATCH_ROWS)) > rows:
        spark.conf.set(_BATCH_ROWS, str(rows))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words, JVM only."""
    return F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long")


def in_fold(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32(doc_id as text) mod ``modulus`` is ``remainder``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus == remainder


def unit_hash(*cols: Column) -> Column:
    """A reproducible uniform double in [0, 1) from the columns' values."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") * F.lit(2.0**-53)


def chunks(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows, so kernels work on bounded pieces whatever Arrow's batch size is."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def id_range(rows: DataFrame, ranges: int, descending: bool = False) -> Column:
    """A number for each row's range of ``doc_id``, rising (or falling) with the id; null ids come last.

    The ranges are of about equal size by approximate quantiles, of which the driver holds one number per
    range. Null ids are spread over as many numbers again by the hash ``key``. Two passes: the first
    reads the ids only.
    """
    ids = rows.select(F.col("doc_id").cast("double").alias("x"))
    cuts = ids.approxQuantile("x", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges)) if ranges > 1 else []
    cuts = np.unique(np.array([c for c in cuts or [] if c is not None], dtype=np.float64))

    @arrow_udf("int")
    def number(x: pa.Array, key: pa.Array) -> pa.Array:
        values = x.to_numpy(zero_copy_only=False).astype(np.float64)
        by_key = (key.to_numpy(zero_copy_only=False).astype(np.float64) / 2.0**64 + 0.5) * ranges
        found = np.searchsorted(cuts, values, side="right")
        found = len(cuts) - found if descending else found
        null = x.is_null().to_numpy(zero_copy_only=False)
        return pa.array(np.where(null, len(cuts) + 1 + np.clip(by_key, 0, ranges - 1).astype(np.int64), found).astype(np.int32))

    return number(F.col("doc_id").cast("double"), F.col("key"))
