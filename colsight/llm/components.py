"""Connected components of a distributed edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsight.session import materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction: neighbours of a node are linked to the smallest of them instead.

    The large star moves the neighbours above a node, the small star the node and those below it. Minima are aggregated
    before the shuffle and joined back, so the neighbours of a node are never gathered in one place.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if large:
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        moved = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = both.where("v < u")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return moved.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """The smallest reachable node of every node that has an edge: (node, component).

    ``edges`` has columns u and v. Self loops, repeated and reversed edges do no harm; nulls must not occur. The table
    is written after every round, which cuts the lineage, and rounds end once the links no longer change; the number of
    rounds grows with the logarithm of the longest path.
    """
    links = materialize(edges.where("u <> v").select("u", "v").distinct(), "links")
    mark = None
    while True:
        links = materialize(_stars(_stars(links, True), False), "links")
        now = links.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, 7))")).first()
        if tuple(now) == mark:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        mark = tuple(now)
