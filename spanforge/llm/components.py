"""Connected components by alternating large-star and small-star steps, each step written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm import common


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Links neighbours to the least neighbour: larger ones (large star) or smaller ones and the node itself (small star)."""
    ways = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # neighbours meet their node's minimum in a join, which splits hot nodes; no node's list is gathered
    if large:
        least = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        got = ways.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = ways.groupBy("u").agg(F.min("v").alias("m"))
        got = ways.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return got.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the ends of edges (u, v); a component is named by its least node."""
    now = common.written(edges.select("u", "v").where("u <> v").distinct())
    while True:
        after = common.written(_stars(_stars(now, True), False))
        common.drop_written(now)
        now = after
        # done when every component is one star: each end points at one node, and no end that is pointed at points on
        if now.select("u").unionByName(now.select(F.col("v").alias("u")).distinct()).groupBy("u").count().where("count > 1").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
