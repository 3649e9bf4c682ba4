"""Connected components by alternating large-star and small-star steps.

Every step is an aggregation with map-side minima and a join with them. Its two sides are shuffled alike, so
that a hub with a large share of the edges is split by skew-join handling; minima of few edges are
broadcast. The edges of each round
are written to the shared folder; a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, discard, store_at


#: Up to so many edges (counted), the minima of a step are broadcast (16 bytes each) instead of stored and shuffled.
BROADCAST_EDGES = 250_000


def _star(pairs: DataFrame, few: bool, kept: list[str]) -> DataFrame:
    """pairs (u, v) with m, the least of u and its v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    if few:
        least = F.broadcast(least)
    else:
        least, path = store_at(least, "star")
        kept.append(path)
    return pairs.join(least, "u").withColumn("m", F.least("u", "m"))


def connected_components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node long, component long) of every node of an edge with two ends; component is its least node.

    edges has columns u and v (long). Null ends, loops, repeated and reversed edges are allowed and
    change nothing. An empty table gives an empty result. Rounds grow with the logarithm of the
    largest component. scratch: keeps the table that the result is read from.
    """
    spark = edges.sparkSession
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, at = store_at(e, "edges")
    before, few = None, e.count() <= BROADCAST_EDGES  # rounds add no edges
    while True:
        kept: list[str] = []
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, few, kept).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large, path = store_at(large, "large")
        small = _star(large, few, kept).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        e, new = store_at(small.select("x.*").where("u <> v").distinct(), "edges")
        discard(spark, at, path, *kept)
        at = new
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    if scratch is not None:
        scratch.paths.append(at)
    leaves = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
