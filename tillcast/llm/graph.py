"""Connected components by alternating large and small stars, as DataFrame joins.

Each round replaces every edge by edges to the smallest neighbour, first among
larger, then among smaller nodes, until only stars around each component's
smallest node are left (a logarithmic number of rounds in practice).  Minima
are pre-aggregated before the shuffle and hub nodes are left to adaptive skew
joins.  Each round is checkpointed into the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _towards_smallest(edges: DataFrame, keep_self: bool) -> DataFrame:
    """For each u: its neighbours v, each linked to the smallest of v and u."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    low = low.select(F.col("u"), F.least("u", "m").alias("m"))
    out = edges.join(low, "u")
    if keep_self:  # small star: u itself is linked too
        return out.select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
    return out.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(u, root) for every node of ``edges`` (u, v): root is the smallest node it reaches.

    Roots themselves are not listed.  No edges give no rows; self-loops and
    repeated edges are ignored.
    """
    edges = cut_lineage(edges.filter("u <> v").distinct())
    before = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _towards_smallest(both, keep_self=False).filter("u <> v").distinct()
        edges = cut_lineage(_towards_smallest(large, keep_self=True).filter("u <> v").distinct())
        # exact sums: hashes as decimals neither overflow nor depend on the order of rows
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select("u", F.col("v").alias("root"))
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
