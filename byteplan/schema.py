"""Schemas of the tables the operators take and return, and blobs made from other tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOBS = "corpus string, path string, content binary, length bigint"
PATTERNS = "corpus string, rank int, key binary, pattern binary, files bigint"
ENTRIES = "path string, method string, original_size bigint, compressed_size bigint, payload binary"


def as_blobs(df: DataFrame, path: Column, content: Column, corpus: Column | None = None) -> DataFrame:
    """Rows as blobs; texts become their UTF-8 bytes."""
    data = content.cast("binary")
    group = F.lit("all") if corpus is None else corpus.cast("string")
    return df.select(group.alias("corpus"), path.cast("string").alias("path"), data.alias("content")).withColumn("length", F.octet_length("content").cast("bigint"))


def render_rows(df: DataFrame, group: Column, order: list[str], fields: list[Column], separator: str = ",", end: str = "\n") -> DataFrame:
    """One text per group: its rows as delimited lines in order (path, content).

    Lines are sorted outside the JVM's heap and joined as they come; a task holds one text.
    """
    line = F.concat(F.concat_ws(separator, *fields), F.lit(end))
    keys = [F.col(c).alias(f"order_{k}") for k, c in enumerate(order)]
    rows = df.select(group.cast("string").alias("path"), *keys, line.alias("line"))
    rows = rows.repartition("path").sortWithinPartitions("path", *[f"order_{k}" for k in range(len(order))], "line")

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, text, begun = None, bytearray(), False
        made = lambda: pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([bytes(text)], pa.binary()).view(pa.string())], names=["path", "content"])
        for batch in batches:
            if not batch.num_rows:
                continue
            lines, runs = batch.column("line"), pc.run_end_encode(batch.column("path"))
            _, offsets, data = lines.buffers()
            places = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(lines.type) else np.int32)[lines.offset :]
            at = 0
            for found, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                if begun and found != path:
                    yield made()
                    text = bytearray()
                path, begun = found, True
                text += memoryview(data)[places[at] : places[end]]  # lines lie end to end
                at = end
        if begun:
            yield made()

    return rows.select("path", "line").mapInArrow(join, "path string, content string")
