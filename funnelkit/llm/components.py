"""Connected components of an edge table, by alternating large and small stars.

Every round is two aggregates and two joins over the edges; the result of a
round is written to the shared folder.  A node with very many edges meets only
map-side minima and joins that may be split, never one window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelkit.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over undirected edges (u, v)."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select("v", "m").unionByName(least.select(F.col("u").alias("v"), "m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (two long columns u, v);
    a component is named by its least node.  Loops and repeats are allowed."""
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        now = stored(_star(_star(now, True), False), "edges")
        mark = now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if mark == before:
            break
        before = mark
    pairs = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pairs.unionByName(pairs.select(F.col("component").alias("node"), "component").distinct())
