"""Connected components of a table of links, by alternating star contractions in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, written


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, component)`` for every id in ``links``; the component is its smallest id.

    A large-star step joins every neighbour above a node to the node's
    smallest neighbour, a small-star step does the same below it; both are a
    grouped minimum (summed before the shuffle) and a join on the node, so a
    hub's links are never gathered in one row.  The minima are written before
    the join: its sides then come to it by exchanges of their own, and Spark
    splits the links of a hub over tasks.  The rounds end when the links
    no longer change; they are logarithmic in the longest chain.  Links with
    a null end and links of a node to itself are ignored.
    """
    edges = written(links.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("m"))
                .where(f"{a} is not null and {b} is not null and {a} <> {b}").distinct())
    before = None
    while True:
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first())
        if now == before or now[0] == 0:
            break
        before = now
        both = edges.select(F.col("v").alias("u"), F.col("m").alias("w")).unionByName(
            edges.select(F.col("m").alias("u"), F.col("v").alias("w")))
        low = cut(both.groupBy("u").agg(F.min("w").alias("lw")).select("u", F.least("u", "lw").alias("low")))
        large = both.join(low, "u").where("w > u").select(F.col("w").alias("v"), F.col("low").alias("m")).distinct()
        large = cut(large)
        least = cut(large.groupBy("v").agg(F.min("m").alias("low")))
        small = large.join(least, "v").select(F.explode(F.array(
            F.struct("v", F.col("low").alias("m")), F.struct(F.col("m").alias("v"), F.col("low").alias("m")))).alias("e"))
        # a table, not a checkpoint: that would hand on the estimated size, which joins multiply round by round
        edges = written(small.select("e.v", "e.m").where("v <> m").distinct())
    roots = edges.select(F.col("m").alias("id"), F.col("m").alias("component")).distinct()
    return edges.select(F.col("v").alias("id"), F.col("m").alias("component")).unionByName(roots)
