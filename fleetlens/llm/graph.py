"""Connected components of a link table, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Scratch


def _canonical(edges: DataFrame) -> DataFrame:
    """u > v, each link once."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (columns u and v, longs): component is the smallest node reachable.

    Alternates large-star and small-star steps until the links no longer change.  No step
    gathers the neighbours of a node: each takes a minimum by node, combined in the map
    tasks, and joins it back.  Every round is written to the shared folder, and the round before removed.  Null ends and self-links are left out.
    """
    scratch = Scratch(links.sparkSession)
    edges = scratch.keep(_canonical(links.where("u is not null and v is not null")), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = _canonical(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        last, edges = edges, scratch.keep(_canonical(small), "links")
        scratch.drop(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    # every link now leads straight to the smallest node of its component
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
