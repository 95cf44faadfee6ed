"""Connected components by alternating large-star and small-star rounds, as DataFrame joins.

Nothing is collected: a round is two grouped minima and two equi-joins whose hot keys adaptive execution can split.
Each round is written to the shared folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One round over edges (u, v) with u > v."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of every node of edges (a, b); component is the smallest node that can be reached."""
    now = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    mark = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    now, before = stored(now, name), None
    while True:
        seen = now.agg(mark.alias("m")).first()["m"]
        if seen[0] == 0 or seen == before:
            break
        before = seen
        now = stored(star(star(now, True), False), name)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
