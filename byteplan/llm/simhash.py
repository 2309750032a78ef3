"""SimHash near-duplicates by pivot distance tables.

Fingerprints are made in Arrow batches (hashing every shingle is the whole cost); the search runs
on distinct fingerprints in DataFrames, by their Hamming distances to reference fingerprints (pivots).

*Candidates.* A base pivot and pivots that differ from it only within some set of bits tell how a
fingerprint lies in those bits: the distances to them, less the distance to the base, are the same for two
fingerprints that do not differ there. The bits are cut into three bands; two fingerprints within two bits do not
differ in at least one of them, so they agree in all its distances. A band's distances, hashed, are a cell.
A cell with many fingerprints is cut again in the same way: its remaining bits into three bands, with pivots
for each, and so on; near fingerprints stay together on at least one path, and after ``LEVELS`` steps a cell has room
for few fingerprints. So cells are small whatever the number of fingerprints or the size of a cluster, no pairs of a
large group are made, and no link is lost.

*Discarding.* Within a cell, pairs whose largest difference of distances to random far pivots exceeds the radius
cannot be near (triangle inequality) and are dropped; the others are verified.

Random pivots alone cannot make the cells: a random pair passes one of them with a chance of a third, and a key
that tolerates differences of two would have to be copied to about two neighbours for each pivot in it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, materialize, text_or_empty
from .components import connected_components

SHINGLE = 3
SEED = 42
#: Fingerprints link at this many differing bits or fewer.
RADIUS = 2
#: Cells with more distinct fingerprints than this are cut again, at most to this depth.
CELL, LEVELS = 64, 6
#: Fingerprints of more rows than this are spread over so many keys when rows meet their groups.
HOT, SALTS = 1000, 64
#: Hashes that are counted bit by bit at once.
BLOCK = 1 << 16

_BASE = 0x5A17C93E6B20D48F
_FAR = tuple(xxhash.xxh64_intdigest(b"pivot %d" % i, SEED) for i in range(8))
#: Which bits of a band a pivot flips; more of them than a band has bits.
_FLIPS = tuple(xxhash.xxh64_intdigest(b"flip %d" % i, SEED) for i in range(24))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None) -> int:
    """SimHash of one text: bit set where over half the shingles' hashes have it set."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = SHINGLE - 1
    if len(words) <= last:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[:-last], ends[last:]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), BLOCK):
        spans = zip(starts[at : at + BLOCK].tolist(), ends[at : at + BLOCK].tolist())
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype=">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(starts)).tobytes(), "big")


def _fingerprints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        values = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
        keep = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(values)], names=[*keep, "fp"])


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, key, fp) for each row; key is a hash of the text that tells rows of one doc_id apart."""
    rows = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("key"), text_or_empty().alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_fingerprints, f"doc_id {id_type}, key long, fp long")


def _distance(a: Column, pivot: int) -> Column:
    return F.bit_count(a.bitwiseXOR(F.lit(_signed(pivot)))).cast("int")


def _bands(level: int) -> tuple[int, int, int]:
    """The three sets of bits, as masks, into which this level cuts what is left.

    The first cuts neighbouring bits; the others cut by digits (or sums of digits) of a bit's number, so that any
    choices of earlier levels are cut evenly.
    """
    if level == 0:
        value = [next(b for b in range(3) if i < 64 * (b + 1) // 3) for i in range(64)]
    else:
        a, b, c = ((1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 1), (1, 2, 1))[level - 1]
        value = [(a * i + b * (i // 3) + c * (i // 9)) % 3 for i in range(64)]
    return tuple(sum(1 << i for i in range(64) if value[i] == k) for k in range(3))


def _cell(fp: Column, band: Column, before: Column) -> Column:
    """The cell, within the cell ``before``, of the distances to the pivots that differ from the base within ``band``."""
    base = _distance(fp, _BASE)
    flipped = [F.lit(_signed(_BASE)).bitwiseXOR(band.bitwiseAND(F.lit(_signed(x)))) for x in _FLIPS]
    return F.xxhash64(before, band, *[F.bit_count(fp.bitwiseXOR(p)).cast("int") - base for p in flipped])


def pivot_table(fingerprints: DataFrame) -> DataFrame:
    """(fp) -> fp, far (distances to the far pivots), cells (block, cell: one for each band of the first level)."""
    fp = F.col("fp")
    cells = [F.struct(F.lit(b).alias("block"), _cell(fp, F.lit(_signed(band)), F.lit(0).cast("long")).alias("cell")) for b, band in enumerate(_bands(0))]
    far = [_distance(fp, p).cast("tinyint").alias(f"d{i}") for i, p in enumerate(_FAR)]
    return fingerprints.select("fp", F.struct(*far).alias("far"), F.array(*cells).alias("cells"))


def _cut(rows: DataFrame, level: int) -> DataFrame:
    """(fp, cell, agreed: bits whose distances made the cell) -> the same, of the next level; cells of one row are left out."""
    rest = F.bitwise_not("agreed")
    bands = F.explode(F.array(*[rest.bitwiseAND(F.lit(_signed(b))) for b in _bands(level)])).alias("band")
    rows = rows.select("fp", "cell", "agreed", bands)
    rows = rows.select("fp", _cell(F.col("fp"), F.col("band"), F.col("cell")).alias("cell"), F.col("agreed").bitwiseOR(F.col("band")).alias("agreed"))
    sizes = rows.groupBy("cell", "agreed").agg(F.count("*").alias("n")).filter("n > 1")
    return rows.join(sizes, ["cell", "agreed"])


def near_links(fingerprints: DataFrame, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """Links (a, b), a < b, between all distinct fingerprints within ``radius`` bits (at most 2).

    ``fingerprints`` has one column ``fp`` of distinct longs; an empty table gives no links.
    """
    if radius > 2:
        raise ValueError("three bands reach two bits")
    rows, found = fingerprints.select("fp", F.lit(0).cast("long").alias("cell"), F.lit(0).cast("long").alias("agreed")), None
    far = F.array(*[_distance(F.col("fp"), p).cast("tinyint") for p in _FAR])
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    for i in range(len(_FAR)):
        near = (F.abs(F.col("x")[i].cast("int") - F.col("y")[i].cast("int")) <= radius) & near
    for level in range(LEVELS):
        rows = materialize(_cut(rows, level))
        last = level == LEVELS - 1 or not rows.filter(F.col("n") > cell).take(1)
        here = rows if last else rows.filter(F.col("n") <= cell)
        left = here.select("cell", "agreed", F.col("fp").alias("a"), far.alias("x"))
        right = left.select("cell", "agreed", F.col("a").alias("b"), F.col("x").alias("y"))
        pairs = left.join(right, ["cell", "agreed"]).filter(near).select("a", "b")
        found = pairs if found is None else found.unionByName(pairs)
        if last:
            break
        rows = rows.filter(F.col("n") > cell).select("fp", "cell", "agreed")
    return found.distinct()


_IDENT = ("doc_id", "key")


def _groups(rows: DataFrame, radius: int) -> DataFrame:
    """(group_fp, n, group_first): each distinct fingerprint, its rows, and the (doc_id, key) its group keeps."""
    ident = F.struct(F.col("doc_id").isNull(), *_IDENT)
    distinct = materialize(rows.groupBy("fp").agg(F.min(ident).alias("first"), F.count("*").alias("n")))
    roots = connected_components(near_links(distinct.select("fp"), radius))
    linked = distinct.join(roots, F.col("fp") == F.col("node")).select("fp", "root", "first")
    firsts = linked.groupBy("root").agg(F.min("first").alias("group_first"))
    linked = linked.join(firsts, "root").select(F.col("fp").alias("linked_fp"), "group_first")
    return distinct.join(linked, F.col("fp") == F.col("linked_fp"), "left").select(
        F.col("fp").alias("group_fp"), "n", F.coalesce("group_first", "first").alias("group_first")
    )


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Groups of near-duplicates: doc_id, key, fp, component_id, keep.

    One row per row of ``docs`` (doc_id, text; other columns are ignored). ``component_id`` is the
    smallest doc_id reachable over links; null doc_ids belong to the group of their text and are
    its id only if there is no other. ``keep`` marks the one (doc_id, key) of each group to keep:
    the smallest, null last. Null and empty texts have fingerprint zero and link like any other;
    equal rows get equal results. An empty table gives an empty result.

    Rows meet their group in two joins: fingerprints with more than ``HOT`` rows are copied to
    ``SALTS`` keys, over which their rows are spread; in the second join those rows go anywhere.
    """
    rows = materialize(with_fingerprints(docs))
    groups = materialize(_groups(rows, radius))
    anywhere = F.xxhash64(*_IDENT, F.lit(SEED))
    hot = groups.filter(F.col("n") > HOT).select(
        F.col("group_fp").alias("hot_fp"), F.col("group_first").alias("hot_first"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("hot_salt")
    )
    rows = rows.withColumn("salt", F.pmod(anywhere, F.lit(SALTS)).cast("int"))
    rows = rows.join(hot, (F.col("fp") == F.col("hot_fp")) & (F.col("salt") == F.col("hot_salt")), "left")
    rows = rows.withColumn("cold_fp", F.when(F.col("hot_first").isNull(), F.col("fp")).otherwise(anywhere))
    rows = rows.join(groups.filter(F.col("n") <= HOT), F.col("cold_fp") == F.col("group_fp"), "left")
    first = F.coalesce("hot_first", "group_first")
    ident = F.struct(F.col("doc_id").isNull(), *_IDENT)
    return rows.select("doc_id", "key", "fp", first["doc_id"].alias("component_id"), (ident == first).alias("keep"))


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, columns as they were.

    The group's smallest doc_id stays, null last; of rows of one doc_id the one whose text has the least hash, and of
    rows that agree in both the one whose columns together do, so reruns agree. Null and empty texts are alike and form
    one group; very long texts are like others. An empty table gives an empty result.
    """
    first = F.col("group_first")
    kept = _groups(materialize(with_fingerprints(docs)), radius).select(first["doc_id"].alias("nd_id"), first["key"].alias("nd_key")).distinct()
    keyed = docs.withColumn("nd_doc_key", F.xxhash64(text_or_empty()))
    on = F.col("doc_id").eqNullSafe(F.col("nd_id")) & (F.col("nd_doc_key") == F.col("nd_key"))
    row = F.struct(*[F.col(c) for c in docs.columns])
    one = keyed.join(kept, on, "left_semi").groupBy("doc_id", "nd_doc_key").agg(F.min_by(row, F.xxhash64(*docs.columns)).alias("nd_row"))
    return one.select(*[F.col("nd_row")[c].alias(c) for c in docs.columns])


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document of ``documents``; odd rows as in ``near_duplicates``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
