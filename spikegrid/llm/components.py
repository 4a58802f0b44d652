"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spikegrid.llm.common import saved

ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b: longs); the component is its
    smallest node. Each round links all larger neighbours of a node to its smallest one
    (sums and joins only, no group is gathered), until nothing changes."""
    stars = edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    stars = saved(stars, "links")
    state = None
    for _ in range(ROUNDS):
        both = stars.union(stars.select("u", "v")).toDF("v", "u")
        least = both.groupBy("v").agg(F.min("u").alias("_m")).select("v", F.least("_m", "v").alias("m"))
        large = both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v")
        small = small.where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")).union(least.select("v", F.col("m").alias("u")))
        stars = saved(small.where("u <> v").distinct(), "links")
        now = stars.agg(F.count(F.lit(1)), F.sum(F.col("u").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components: not settled after {ROUNDS} rounds")
    found = stars.groupBy("v").agg(F.min("u").alias("component")).select(F.col("v").alias("node"), "component")
    return found.union(stars.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
