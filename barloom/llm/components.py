"""Connected components of a distributed edge list, by alternating large and small stars.

Each round links every node to the least node it knows of, first among larger then among smaller
neighbours (the published two-step scheme, which takes few rounds). A node
with very many neighbours costs combined minima and one joined row per edge, never a group in one
task. Lineage is cut after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.session import durable


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``node, root`` for every node that has an edge to another one; root is the least node of the
    component. Loops, repeated edges and nulls are allowed and add nothing. No edges: no rows."""
    e = durable(
        edges.where(F.col(u) != F.col(v))
        .select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b"))
        .distinct()
    )
    mark = _mark(e)
    while mark[0]:
        e = durable(_small(_large(e)))
        now = _mark(e)
        if now == mark:
            break
        mark = now
    stars = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _mark(e: DataFrame) -> tuple:
    """Size and two order-free sums that tell whether a round changed the edges."""
    return tuple(
        e.agg(
            F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))
        ).first()
    )


def _large(e: DataFrame) -> DataFrame:
    """Link the larger neighbours of each node to the least of its neighbours and itself."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m"))
    return (
        both.where("b > a")
        .join(low, "a")
        .select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        .distinct()
    )


def _small(e: DataFrame) -> DataFrame:
    """Link the smaller neighbours of each node, and the node, to the least of them."""
    low = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct()
