"""Mixing sources to target weights by pivotal dependent rounding (DataFrame operations only).

Every source gets a target number of words. All documents of a source want the same expected
number of copies ``f = target / source size``; ``floor(f)`` copies are certain and the rest is a
probability. Pivotal rounding meets two documents at a time and randomly moves *word mass*
between them, keeping their sum, until one of them is wholly in or wholly out; the other goes on
to meet the next. Documents meet in leaves of a few dozen, the survivors of the leaves meet
again, and so on: a reduction tree of logarithmic depth, so a source with a third of all rows is
spread over as many leaves as it needs. The one document per source left at the root is taken in
part, which brings the source within one word of its target.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_or_empty, word_count

#: Mean number of documents that meet in one node of the tree.
FANOUT = 48
#: More sources than this are joined by a shuffle and not by a broadcast.
BROADCAST_SOURCES = 100_000

_DOC = "struct<doc_id:{id},dup:int,size:bigint,key:bigint,h:bigint,x:double>"


def source_targets(per_source: DataFrame, weights: Sequence[float], share: float, limit: float) -> DataFrame:
    """Targets by water filling: (source, n_docs, source_size) -> + weight, target.

    Sources in code-point order, null last, take the weights in turn and share ``share`` times all
    words; no target exceeds ``limit`` times its source's size, what is cut is shared again by
    weight. In order of size per weight the capped sources are a prefix, so prefix sums give the
    water level directly; the windows run over one row per source.
    """
    n = len(weights)
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % n + 1).cast("int"))
    src = per_source.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(limit)))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    src = src.withColumn("level", level).withColumn("rank", F.row_number().over(by_ratio))
    free = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("rank", "level"))
    src = src.withColumn("water", F.coalesce(F.min(free).over(everything)["level"], F.lit(float("inf"))))
    return src.select(
        "source", "n_docs", "source_size", F.least(F.col("cap"), F.col("water") * F.col("weight")).alias("target")
    )


def _join_sources(rows: DataFrame, sources: DataFrame, small: bool) -> DataFrame:
    side = sources.withColumnRenamed("source", "src")
    return rows.join(F.broadcast(side) if small else side, F.col("source").eqNullSafe(F.col("src"))).drop("src")


def _meet(id_type: str, seed: int) -> str:
    """SQL: fold a leaf's documents into (carry, done); x is a document's word mass, 0..size."""
    doc = _DOC.format(id=id_type)
    pair = f"""
      transform(array(named_struct(
        'up', least(a.carry.size - a.carry.x, d.x), 'down', least(a.carry.x, d.size - d.x),
        'u', cast(shiftrightunsigned(xxhash64(a.carry.h, d.h, {seed}L), 11) as double) * pow(2.0D, -53))), m ->
      CASE WHEN m.u * (m.up + m.down) < m.down THEN named_struct(
        'p', CASE WHEN a.carry.size - a.carry.x <= d.x THEN cast(a.carry.size as double) ELSE a.carry.x + d.x END,
        'q', CASE WHEN a.carry.size - a.carry.x < d.x THEN d.x - m.up ELSE 0.0D END)
      ELSE named_struct(
        'p', CASE WHEN a.carry.x <= d.size - d.x THEN 0.0D ELSE a.carry.x - m.down END,
        'q', CASE WHEN a.carry.x < d.size - d.x THEN d.x + m.down ELSE cast(d.size as double) END) END)[0]"""
    with_x = "named_struct('doc_id', {0}.doc_id, 'dup', {0}.dup, 'size', {0}.size, 'key', {0}.key, 'h', {0}.h, 'x', {1})"
    done = f"cast(array() as array<{doc}>)"
    return f"""aggregate(docs, named_struct('carry', cast(null as {doc}), 'done', {done}), (a, d) ->
      CASE WHEN a.carry IS NULL THEN named_struct('carry', d, 'done', a.done)
      ELSE transform(array({pair}), t -> named_struct(
        'carry', CASE WHEN t.p <= 0.0D OR t.p >= a.carry.size THEN
                   CASE WHEN t.q <= 0.0D OR t.q >= d.size THEN cast(null as {doc}) ELSE {with_x.format("d", "t.q")} END
                 ELSE {with_x.format("a.carry", "t.p")} END,
        'done', concat(a.done,
          CASE WHEN t.p <= 0.0D OR t.p >= a.carry.size THEN array({with_x.format("a.carry", "t.p")}) ELSE {done} END,
          CASE WHEN t.q <= 0.0D OR t.q >= d.size THEN array({with_x.format("d", "t.q")}) ELSE {done} END)))[0] END)"""


def mix_plan(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    limit: float = 2.0,
    seed: int = 42,
) -> DataFrame:
    """How many words the mix takes of each row of ``docs`` (doc_id, source, text).

    Returns one row per input row: doc_id, source, dup (which of several equal rows), key (hash of
    the text), size, source_size, target, taken. Null texts have size 0, a null source is a source
    of its own and comes last, a null doc_id is an ordinary value; rows that repeat are separate
    rows with their own decision. Other columns are ignored. An empty table gives an empty plan.
    Reruns agree: all randomness is a hash of ids and ``seed``.
    """
    rows = docs.select(
        "doc_id", "source", word_count(text_or_empty()).alias("size"), F.xxhash64(text_or_empty()).alias("key")
    )
    # Equal rows collapse to a count here and come back by explode below: a document repeated
    # without end never lands in one task, and the index among its copies needs no window.
    grouped = materialize(rows.groupBy("doc_id", "source", "size", "key").agg(F.count("*").alias("n")))
    per_source = grouped.groupBy("source").agg(
        F.sum("n").alias("n_docs"), F.sum(F.col("size") * F.col("n")).alias("source_size")
    )
    sources = materialize(source_targets(per_source, weights, share, limit))
    n_sources, largest = sources.agg(F.count("*"), F.coalesce(F.max("n_docs"), F.lit(0))).first()
    small = n_sources <= BROADCAST_SOURCES

    wants = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    every = (
        _join_sources(grouped, sources, small)
        .withColumn("dup", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
        .withColumn("x", (wants - F.floor(wants)) * F.col("size"))
        .withColumn("h", F.xxhash64("doc_id", "source", "key", "dup", F.lit(seed)))
    )
    fixed = (F.col("size") == 0) | (F.col("x") <= 0)
    fields = ["doc_id", "dup", "size", "key", "h", "x"]
    meet = F.expr(_meet(docs.schema["doc_id"].dataType.simpleString(), seed))
    no_carry = F.col("out.carry").isNull()
    settled = [every.filter(fixed).select("source", "doc_id", "dup", "size", "key", F.lit(0.0).alias("x"))]
    node = F.pmod("h", F.ceil(F.col("n_docs") / FANOUT))
    pending = every.filter(~fixed).select("source", node.alias("node"), F.struct(*fields).alias("doc"))
    while True:
        largest = -(-largest // FANOUT)
        met = materialize(
            pending.groupBy("source", "node")
            .agg(F.array_sort(F.collect_list(F.struct("doc.h", "doc"))).alias("in"))
            .withColumn("docs", F.transform("in", lambda e: e["doc"]))
            .withColumn("out", meet)
            .select("source", "node", no_carry.alias("closed"), "out.done", "out.carry")
            .withColumn("all", F.when(F.col("closed"), F.col("done")).otherwise(F.concat("done", F.array("carry"))))
            .select("source", "node", "closed", F.size("all").alias("n"), F.posexplode("all").alias("at", "doc"))
            .select("source", "node", "doc", (F.col("closed") | (F.col("at") < F.col("n") - 1)).alias("done"))
        )
        last = largest <= 1
        settled.append((met if last else met.filter("done")).select("source", *[f"doc.{c}" for c in fields if c != "h"]))
        if last:
            break
        pending = met.filter("NOT done").select("source", F.floor(F.col("node") / FANOUT).alias("node"), "doc")
    plan = settled[0]
    for part in settled[1:]:
        plan = plan.unionByName(part)
    return _join_sources(plan, sources, small).select(
        "doc_id", "source", "dup", "key", "size", "source_size", "target",
        (F.floor(wants).cast("long") * F.col("size") + F.floor(F.col("x") + 0.5).cast("long")).alias("taken"),
    )


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each distinct document it takes, with text, size, taken and copies.

    Rows of equal (doc_id, source, text) come out as one row whose ``rows`` says how many there
    were and whose ``taken`` is their sum; documents of which the mix takes nothing are absent,
    unless they have no words at all (there is nothing to take or leave). Where such rows differ in
    ``lang``, the least is shown, null first, so reruns agree. An empty table gives an empty mix.
    """
    same = ["doc_id", "source", "size", "key"]
    plan = mix_plan(docs, **options)
    plan = plan.groupBy(*same, "source_size", "target").agg(F.count("*").alias("rows"), F.sum("taken").alias("taken"))
    keyed = docs.select(
        F.col("doc_id").alias("d_id"), F.col("source").alias("d_source"), F.xxhash64(text_or_empty()).alias("d_key"), "text", "lang"
    )
    keyed = keyed.groupBy("d_id", "d_source", "d_key").agg(F.min("text").alias("text"), F.min(F.struct("lang"))["lang"].alias("lang"))
    on: Column = (
        F.col("doc_id").eqNullSafe(F.col("d_id")) & F.col("source").eqNullSafe(F.col("d_source")) & (F.col("key") == F.col("d_key"))
    )
    copies = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(F.lit(0.0))
    return (
        plan.filter((F.col("taken") > 0) | (F.col("size") == 0))
        .join(keyed, on)
        .select("doc_id", "text", "lang", "source", "size", "source_size", "target", "rows", "taken", copies.alias("copies"))
    )


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    """The plan of the mix for every document of ``documents``; odd rows as in ``mix_plan``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_plan(docs).select("doc_id", "size", "source_size", "target", "taken")
