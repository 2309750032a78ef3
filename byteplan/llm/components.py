"""Connected components by alternating large-star and small-star steps, wholly in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) links between long ids -> (node, root): each linked node and its component's least id.

    Direction, repeats and self-links do not matter. Every round rewires each node's neighbours to
    its least neighbour, first the larger ones, then the smaller ones; it ends when nothing changes,
    after a number of rounds that grows with the logarithm of the longest chain. Minima are
    aggregated before the shuffle, and only joins see a hub's links together, where adaptive
    execution can split them. Links and components stay on the executors.
    """
    edges = materialize(_larger_first(links.select("a", "b")))
    state = _state(edges)
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = _larger_first(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        edges = materialize(_larger_first(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b"))))
        previous, state = state, _state(edges)
        if state == previous:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _larger_first(links: DataFrame) -> DataFrame:
    links = links.filter("a <> b")
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    """Equal for equal sets of links, up to a 64-bit checksum."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())
