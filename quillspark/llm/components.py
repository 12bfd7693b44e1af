"""Connected components by alternating large-star and small-star rounds, all in the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import drop, materialize


def _nearest(sides: DataFrame) -> DataFrame:
    """Each row (u, v) with m, the smallest of u and all its neighbours.

    The minimum is aggregated map-side first and joined back, so that adaptive execution can split a hub.
    """
    least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return sides.join(least, "u")


def _round(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _nearest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    # after the large star every edge leads from a node to a smaller one
    small = _nearest(large)
    return small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """(node, component) for every node with an edge; the component is its smallest node.

    ``edges`` has two long columns; nulls, loops, repeats and either direction are allowed. The
    rounds needed grow with the logarithm of the longest path. Each round is written to the shared
    folder, the one before is deleted, and only a row count and a checksum reach the driver.
    """
    spark = edges.sparkSession
    now = edges.select(F.col(left).cast("long").alias("u"), F.col(right).cast("long").alias("v"))
    now = now.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, path = materialize(now, "edges")
    seen = None
    while True:
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if not sums[0] or tuple(sums) == seen:
            break
        seen = tuple(sums)
        new, new_path = materialize(_round(now), "edges")
        drop(spark, path)
        now, path = new, new_path
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
