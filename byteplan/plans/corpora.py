"""Synthetic corpora to try things on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import as_blobs, render_rows


def log_corpus(spark: SparkSession, files: int = 40, rows: int = 500, header_bytes: int = 640) -> DataFrame:
    """Blobs of delimited log rows under one long header line that all of them share.

    Of ten columns only the row number and the time vary within a file, so rows are templates and the
    header is what a dictionary across files can save.
    """
    base = spark.range(files * rows).select(F.floor(F.col("id") / rows).alias("f"), (F.col("id") % rows).alias("r"))
    fields = [F.col("r").cast("string"), (F.lit(1_700_000_000_000) + F.col("f") * 1_000_000 + F.col("r") * 137).cast("string")]
    fields += [F.lit(x) for x in ("INFO", "gateway", "eu-west", "v2.4.1", "GET", "/api/items", "200", "ok")]
    body = render_rows(base, F.format_string("logs/%04d.csv", "f"), ["r"], fields)
    unit = '{"schema":["row_id","ts_ms","level","service","region","version","method","route","status","result"],"encoding":"utf-8","owner":"platform"}'
    header = (unit * (header_bytes // len(unit) + 1))[: header_bytes - 1] + "\n"
    return as_blobs(body, F.col("path"), F.concat(F.lit(header), F.col("content")))
