"""Connected components of a table of links, by alternating large-star and small-star steps over DataFrames.

Each step is a minimum per node (combined before the shuffle) and a join back to the links. The links of one node are one key of
that join: Spark's sorted join streams them and splits a key that adaptive execution finds large, but the key itself isn't
salted. Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` (u, v) with u > v. Large: a node's larger neighbours move to its smallest; small: its smaller ones do."""
    seen = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = seen.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    moved = seen.join(least, "u")
    if large:
        out = moved.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v")


def _stars(edges: DataFrame) -> bool:
    """Whether no node is the end of one link and the start of another, or the start of two. One aggregation."""
    ends = edges.select("u", F.lit(1).alias("starts"), F.lit(0).alias("ends")).union(edges.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("u").agg(F.sum("starts").alias("starts"), F.max("ends").alias("ends"))
    return not nodes.filter("starts > 1 or (starts = 1 and ends = 1)").agg(F.count("*")).first()[0]


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for the nodes of ``links``; component is the smallest node reachable. Loops and nulls are ignored."""
    edges = stored(links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "components")
    while not _stars(edges):
        edges = stored(_star(_star(edges, True), False).distinct(), "components")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
