"""Connected components of a graph of any size, by alternating large-star and small-star steps on an edge table.

Each step is one aggregation and one join; nothing about the graph comes to the driver but a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.llm.common import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """edges(a long, b long) -> (id, component): every node of an edge with the smallest node it is connected to.

    Loops, repeated edges and either direction are fine; an edge with a null end is left out; no edges give no rows.
    A hub with very many neighbours is pre-aggregated in the minimum, and its join is one that Spark can split.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, seen = materialise(e), None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == seen:
            break
        seen = now
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        following = materialise(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct())
        discard(e)
        e = following
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
