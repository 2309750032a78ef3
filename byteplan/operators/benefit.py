"""What references really save, beside what is predicted: sizes with and without them.

The measure is the deflated program, as it would be stored. References help where they save over a hundredth.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..kernels import dictionary, lz
from ..kernels.profile import entropy

#: The saving that counts; sizes of dictionaries that a curve looks at.
LEAST_BENEFIT = 0.01
CURVE = (1, 2, 3, 5, 8, 12, 18, 25, 35, 50, 75, 100, 150, 200, 500)


def plain_size(data: bytes) -> int:
    return len(zlib.compress(lz.compress_naive(data), 1))


def referenced_size(data: bytes, patterns: Sequence[bytes]) -> int:
    """Size with references to the patterns; a program that does not give the data back is an error."""
    numbered = dict(enumerate(patterns))
    program = dictionary.compress_with_references(data, numbered)
    if dictionary.decompress_with_references(program, numbered) != data:
        raise ValueError("references do not give the data back")
    return len(zlib.compress(program, 1))


def measured(rows: DataFrame) -> DataFrame:
    """(path, n_patterns, h_pattern, coverage, predicts_benefit, plain, referenced, benefit, helps, correct) of (path, content, patterns).

    Each blob has a dictionary of its own, of bounded size. Null content counts as empty, null patterns as none;
    without patterns nothing is saved.
    """

    def one(path: str | None, data: bytes | None, patterns: list | None) -> tuple:
        data, patterns = data or b"", patterns or []
        found = dictionary.predict_benefit(data, dict(enumerate(patterns)))
        plain = plain_size(data)
        referenced = referenced_size(data, patterns) if patterns else plain
        benefit = (plain - referenced) / plain
        helps = benefit > LEAST_BENEFIT
        return path, len(patterns), found["h_pattern"], found["coverage"], found["predicts_benefit"], plain, referenced, benefit, helps, helps == found["predicts_benefit"]

    names = ["path", "n_patterns", "h_pattern", "coverage", "predicts_benefit", "plain", "referenced", "benefit", "helps", "correct"]
    types = [pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.bool_()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for made in map(one, *(batch.column(c).to_pylist() for c in ("path", "content", "patterns"))):
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(made, types)], names=names)

    schema = "path string, n_patterns int, h_pattern double, coverage double, predicts_benefit boolean, plain long, referenced long, benefit double, helps boolean, correct boolean"
    return rows.select("path", "content", "patterns").mapInArrow(run, schema)


def benefit_curve(blobs: DataFrame, patterns: Sequence[bytes], sizes: Sequence[int] = CURVE) -> DataFrame:
    """(n, h_pattern, covered, total, plain, referenced, benefit, helps): the first ``n`` patterns of a ranked dictionary.

    Sizes beyond the dictionary mean all of it. Every blob is read once; sums of a task meet, not rows. Without
    patterns or blobs there are no rows.
    """
    patterns = [bytes(p) for p in patterns]
    sizes = sorted({min(s, len(patterns)) for s in sizes} - {0})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {n: [0, 0, 0, 0] for n in sizes}
        some = False
        for batch in batches:
            for data in batch.column("content").to_pylist():
                data, some = data or b"", True
                plain = plain_size(data)
                for n, s in sums.items():
                    first = patterns[:n]
                    covered = sum(b - a for a, b, _ in dictionary.find_matches(data, dict(enumerate(first))))
                    for k, v in enumerate((covered, len(data), plain, referenced_size(data, first))):
                        s[k] += v
        if some:
            columns = list(zip(*((n, *s) for n, s in sums.items()))) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["n", "covered", "total", "plain", "referenced"])

    parts = blobs.select("content").mapInArrow(run, "n long, covered long, total long, plain long, referenced long")
    sums = parts.groupBy("n").agg(*[F.sum(c).alias(c) for c in ("covered", "total", "plain", "referenced")])
    spread = F.create_map(*[F.lit(v) for n in sizes for v in (n, entropy(b"".join(patterns[:n])))]) if sizes else F.lit(None).cast("map<int,double>")
    benefit = (F.col("plain") - F.col("referenced")) / F.col("plain")
    out = sums.select(F.col("n").cast("int").alias("n"), "covered", "total", "plain", "referenced", benefit.alias("benefit"), (benefit > LEAST_BENEFIT).alias("helps"))
    return out.withColumn("h_pattern", spread[F.col("n")])


def crossings(curve: DataFrame) -> DataFrame:
    """(from_n, to_n, from_coverage, to_coverage, threshold): where more patterns begin to help.

    A curve has a row for each size asked for, so one task orders it.
    """
    share = F.when(F.col("total") > 0, F.col("covered") / F.col("total")).otherwise(0.0)
    order = Window.orderBy("n")
    rows = curve.select("n", "helps", share.alias("c"))
    rows = rows.select("n", "helps", "c", *[F.lag(x).over(order).alias(f"last_{x}") for x in ("n", "helps", "c")])
    rows = rows.filter("helps AND NOT last_helps")
    return rows.select(F.col("last_n").alias("from_n"), F.col("n").alias("to_n"), F.col("last_c").alias("from_coverage"), F.col("c").alias("to_coverage"), ((F.col("last_c") + F.col("c")) / 2).alias("threshold"))


def sweep_coverage(blobs: DataFrame, candidates: DataFrame, thresholds: Sequence[int] = (2, 3, 5), n: int = 100) -> DataFrame:
    """(min_files, n_patterns, avg_len, h_pattern, mean_coverage): the dictionary selected for each threshold of files.

    At most ``n`` patterns a threshold come to the driver, and thresholds are few. ``mean_coverage`` is the mean over
    blobs, empty and null ones counting as uncovered; a threshold that no pattern meets has no row.
    """
    from . import mining

    chosen = {t: mining.select_patterns(candidates.filter(F.col("files") >= t), n) for t in thresholds}
    chosen = {t: patterns for t, patterns in chosen.items() if patterns}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, seen = dict.fromkeys(chosen, 0.0), 0
        for batch in batches:
            for data in batch.column("content").to_pylist():
                seen += 1
                for t, patterns in chosen.items():
                    sums[t] += dictionary.coverage(data or b"", dict(enumerate(patterns)))
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.float64()), pa.array([seen] * len(sums), pa.int64())], names=["min_files", "share", "seen"])

    parts = blobs.select("content").mapInArrow(run, "min_files int, share double, seen long")
    means = parts.groupBy("min_files").agg((F.sum("share") / F.sum("seen")).alias("mean_coverage"))
    facts = [(t, len(p), sum(map(len, p)) / len(p), entropy(b"".join(p))) for t, p in chosen.items()]
    made = blobs.sparkSession.createDataFrame(facts, "min_files int, n_patterns int, avg_len double, h_pattern double")
    return made.join(F.broadcast(means), "min_files")
