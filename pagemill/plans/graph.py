"""Connected components of an edge list, without collecting any component."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pagemill.plans.durable import durable


def components(edges: DataFrame, a: str, b: str, most_rounds: int = 50) -> DataFrame:
    """(node, component): the smallest node of each node's component; nodes without edges don't occur.

    Alternating large-star and small-star rounds (Kiveris et al., 2014), each two aggregations with map-side combine;
    a hub's edges are never gathered, only its minimum.  Loops and repeated edges are harmless; nulls are dropped.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = durable(e, "edges")
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        new = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        new = durable(new, "edges")
        same = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() == e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        e = new
        if same:
            break
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
