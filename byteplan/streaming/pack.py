"""Blobs that arrive over time: packing them batch by batch, and running counts of their patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..kernels import dictionary
from ..plans.pack import archives, encode_entries


def pack_stream(blobs: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write each micro-batch of a stream of blobs as archives in a folder of its own; a repeated batch replaces itself."""
    from ..sources.archive import write_files

    def batch(rows: DataFrame, number: int) -> None:
        write_files(archives(encode_entries(rows)), f"{path.rstrip('/')}/batch={number}")

    return blobs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def pattern_counts(blobs: DataFrame, length: int = 16) -> DataFrame:
    """(pattern, files) so far: in how many blobs of the stream each strided substring of one length occurs."""
    if length not in dictionary.STRIDED_LENGTHS:
        raise ValueError(f"length must be one of {dictionary.STRIDED_LENGTHS}")
    places = F.sequence(F.lit(0), (F.col("length") - length).cast("int"), F.lit(length // 2))
    patterns = F.array_distinct(F.transform(places, lambda i: F.substring("content", i + 1, F.lit(length))))
    rows = blobs.filter(F.col("length") >= length).select(F.explode(patterns).alias("pattern"))
    return rows.groupBy("pattern").agg(F.count("*").alias("files"))
