"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.plans.tables import Stash, bounded


def _toward_least(stash: Stash, links: DataFrame) -> DataFrame:
    """From (u, v): each v linked to the least of u and u's neighbours."""
    least = stash.put(links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return links.join(bounded(least), "u")


def connected_components(edges: DataFrame, stash: Stash) -> DataFrame:
    """(id, component) for every node of ``edges`` (a, b); the component is its least node.

    Only aggregations and joins are used: a hub's edges are never gathered in one place. Each round's edges
    are written to shared storage, so the plan stays short and a lost executor costs little. Rounds go on until
    nothing changes, which takes about as many as the longest path has binary digits.
    """
    now = stash.put(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _toward_least(stash, both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stash.put(large.where("u != v").distinct(), "large")
        small = _toward_least(stash, large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        now = stash.put(small.where("u != v").distinct(), "small")
        # settled: every node has one parent, and no parent has a parent
        parents = now.groupBy("u").agg(F.count("*").alias("parents"))
        loose = parents.join(now.select(F.col("v").alias("u"), F.lit(True).alias("above")).distinct(), "u", "left").where("parents > 1 or above")
        if loose.isEmpty():
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
