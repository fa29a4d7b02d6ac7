"""Connected components of a distributed edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binsieve.llm.common import written


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.shiftright(F.xxhash64("v", "u"), 24))).first())


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) for every node of an undirected edge list, root the smallest node it reaches.

    Self-loops and repeated edges are harmless; nodes without edges don't appear; an empty list gives
    an empty result. Nothing but a count and a checksum comes to the driver. Each round is written to
    the shared folder; minima are taken with map-side aggregation and joined back from a written
    table, so that a node with a large part of all edges is split by the skew join.
    """
    edges = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct()
    held = written(edges, "edges")
    before = _sum(held)
    while before[0]:
        both = held.union(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "large-least")
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "small-least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", "m"))
        held = written(small.distinct(), "small")
        after = _sum(held)
        if after == before:
            break
        before = after
    roots = held.select("v").distinct()
    return held.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("v", "v"))
