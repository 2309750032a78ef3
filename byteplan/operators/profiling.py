"""Profiles of blobs and of their parts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.builtin import apply_magic, looks_json
from ..functions.udfs import functions

_K = functions()


def blob_profile(blobs: DataFrame) -> DataFrame:
    """corpus, path, length, n_lines, byte_entropy, compressed, json for each blob; one pass, no shuffle."""
    text = F.decode("content", "ISO-8859-1")  # one character per byte
    return blobs.select(
        "corpus", "path", "length",
        F.when(F.col("length") == 0, 0).otherwise(F.size(F.split(text, "\n", -1))).cast("bigint").alias("n_lines"),
        _K["byte_entropy"]("content").alias("byte_entropy"),
        apply_magic(F.col("content")).alias("compressed"),
        looks_json(text).alias("json"),
    )


def corpus_profile(blobs: DataFrame) -> DataFrame:
    """Per corpus: blobs, bytes, lines, mean entropy and redundancy; one aggregation, combined before its shuffle."""
    rows = blob_profile(blobs)
    return rows.groupBy("corpus").agg(
        F.count("*").alias("n_blobs"),
        F.sum("length").alias("n_bytes"),
        F.sum("n_lines").alias("n_lines"),
        F.avg("byte_entropy").alias("mean_entropy"),
        F.sum(F.col("length") * (1 - F.col("byte_entropy") / 8)).alias("redundancy"),
    )


def byte_histogram(blobs: DataFrame) -> DataFrame:
    """(corpus, byte, n): 256 counters per batch reach the shuffle, not a row per byte."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str | None, np.ndarray] = {}
        for batch in batches:
            for corpus, data in zip(batch.column("corpus").to_pylist(), batch.column("content")):
                if data.is_valid:
                    found = np.bincount(np.frombuffer(data.as_buffer(), np.uint8), minlength=256)
                    sums[corpus] = sums.get(corpus, 0) + found
        for corpus, counts in sums.items():
            used = np.flatnonzero(counts)
            columns = [pa.array([corpus] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(counts[used], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["corpus", "byte", "n"])

    parts = blobs.select("corpus", "content").mapInArrow(count, "corpus string, byte int, n long")
    return parts.groupBy("corpus", "byte").agg(F.sum("n").alias("n"))


def classify(blobs: DataFrame) -> DataFrame:
    """The five metrics of each blob and its class."""
    rows = blobs.withColumn("m", _K["class_metrics"]("content"))
    return rows.select("corpus", "path", "length", "m.*", _K["classify_metrics"]("m", "content").alias("data_class"))


def lz_statistics(blobs: DataFrame) -> DataFrame:
    """Token statistics of each blob's parse, counted where it is made; no tokens leave the kernel."""
    rows = blobs.withColumn("t", _K["lz_statistics"]("content"))
    n, literal, match = F.col("t.n_matches"), F.col("t.literal_bytes"), F.col("t.match_bytes")
    return rows.select(
        "corpus", "path", "length", "t.n_literals", "t.n_matches", "t.literal_bytes", "t.match_bytes",
        F.when(F.col("length") == 0, 1.0).otherwise(literal / F.greatest("length", F.lit(1))).alias("literal_fraction"),
        F.when(n == 0, 0.0).otherwise(match / F.greatest(n, F.lit(1))).alias("avg_match_len"),
    )


def tokens(blobs: DataFrame) -> DataFrame:
    """One row per token of each blob's parse."""
    return blobs.select("path", F.explode(_K["lz_tokens"]("content")).alias("t")).select("path", "t.*")


def delimiter_runs(lines: DataFrame, delimiter: str) -> DataFrame:
    """(path, line_no, line) -> the longest run of lines with one number of delimiters in each path.

    Gaps and islands; the earliest of equally long runs. Blobs whose lines fit one task are better served
    by the ``find_rows`` kernel; this form has no such limit but one path's lines meet in one window.
    """
    from ..functions.builtin import count_delimiters

    counted = lines.withColumn("n_delimiters", count_delimiters(F.col("line"), delimiter))
    island = F.col("line_no") - F.row_number().over(Window.partitionBy("path", "n_delimiters").orderBy("line_no"))
    runs = counted.withColumn("island", island).groupBy("path", "n_delimiters", "island").agg(
        F.min("line_no").alias("first_line"), F.count("*").alias("n_rows")
    )
    best = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("n_rows"), "first_line"))
    return runs.withColumn("place", best).filter("place = 1").select("path", "n_delimiters", "first_line", "n_rows")


def fixed_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_values, fixed): which columns of a table hold one value only."""
    counts = rows.agg(*[F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_values")) for c in columns]))
    return counts.select(pairs.alias("p")).select("p.column", "p.n_values", (F.col("p.n_values") <= 1).alias("fixed"))
