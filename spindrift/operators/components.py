"""Forests and graphs: roots of parent pointers, connected components of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written


def roots(parents: DataFrame) -> DataFrame:
    """id, root for a forest of (id, parent); a root is its own parent.

    Pointer jumping: each round doubles the distance, so rounds grow with the logarithm of
    the depth. Each round is written to the shared folder.
    """
    now = written(parents.select("id", F.col("parent").alias("root")), "roots")
    while True:
        up = now.select(F.col("id").alias("root"), F.col("root").alias("next"))
        step = written(now.join(up, "root").select("id", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "roots")
        now = step.select("id", "root")
        if step.where("moved").isEmpty():
            return now


def _stars(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    down = large.groupBy("u").agg(F.min("v").alias("m"))
    return large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def linked_components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of ``links`` (a, b).

    Alternating large-star and small-star steps, each written to the shared folder. A node
    with very many neighbours is only aggregated with partial sums and joined, so Spark can
    split it. Rounds grow with the logarithm of the longest chain.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if state == before or not state[0]:
            break
        before, edges = state, written(_stars(edges), "links")
    least = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return least.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) for every id of ``nodes``, over links (a, b)."""
    found = linked_components(links).withColumnRenamed("node", "id")
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
