"""Connected components of an edge table: alternating large-star and small-star rounds.

Each round maps every edge to the smallest neighbour known so far, first over all neighbours, then over the smaller
ones; the edges end as one star per component.  A node's least neighbour is a pre-aggregated minimum joined back to the
edges.  Nodes with over 1 / ``HUBS`` of all edges, fewer than ``HUBS`` of them at any size, are broadcast for that join; all
others have so few edges that no task gets many of one key.  Rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.sources.scratch import drop_stash, stash

MAX_ROUNDS = 60
HUBS = 1000


def _with_least(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """``edges`` with column m of ``least`` (u, m, n: rows of each u) for a = u; ``total`` bounds the rows of ``edges``."""
    hub = F.col("n") > total // HUBS
    hubs = F.broadcast(least.where(hub).select("u", "m"))
    at_hubs = edges.join(hubs, F.col("a") == F.col("u")).select("a", "b", "m")
    others = edges.join(hubs.select("u"), F.col("a") == F.col("u"), "left_anti").join(least.where(~hub), F.col("a") == F.col("u")).select("a", "b", "m")
    return at_hubs.union(others)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return _with_least(both, least, 2 * total).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    least = edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = _with_least(edges, least, total).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node that can be reached) for every node of an edge (columns a and b, any order)."""
    ordered = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    loops = ordered.where("a = b").select(F.col("a").alias("node"))
    now = stash(ordered.where("a <> b"), "components")
    total, before = now.count(), None
    for _ in range(MAX_ROUNDS):
        if not total:
            break
        starred = stash(_large_star(now, total), "components")
        then = stash(_small_star(starred, total), "components")
        drop_stash(now, starred)
        now = then
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0]
        if state == before:
            break
        total, before = state[0], state
    else:
        raise RuntimeError(f"components are not settled after {MAX_ROUNDS} rounds")
    found = now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")))
    return found.union(loops.select("node", F.col("node").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
