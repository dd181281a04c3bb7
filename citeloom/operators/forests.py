"""Spanning forests of weighted graphs, strong components, and the order of a citation graph with cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.operators.components import connected_components
from citeloom.operators.graph import EdgeLayout, topological_levels
from citeloom.operators.skew import join_by
from citeloom.sources.scratch import drop_stash, stash, stash_bucketed, stashed_union


def spanning_forest(edges: DataFrame, largest: bool = False, simple: bool = False) -> DataFrame:
    """a < b, weight: the spanning forest of least (or largest) weight of an undirected graph (a, b, weight).

    Rounds of Boruvka: every component picks its best edge leading out, the picked ones contract it with others, and of edges that
    are parallel then the best stays.  Equal weights are ordered by (a, b), so the forest is one and has no cycle.
    The number of components at least halves in a round.  ``simple``: each pair has one row, a < b.
    """
    cost = -F.col("weight") if largest else F.col("weight")
    if simple:
        one = edges.select("a", "b", cost.alias("cost"))
    else:
        plain = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), cost.alias("cost"))
        one = plain.groupBy("a", "b").agg(F.min("cost").alias("cost"))
    now = stash(one.select("cost", "a", "b", F.col("a").alias("ca"), F.col("b").alias("cb")), "forest-edges")
    edge = F.struct("cost", "a", "b", "ca", "cb")
    picked: list[DataFrame] = []
    while True:
        ends = now.select(F.col("ca").alias("c"), edge.alias("e")).union(now.select(F.col("cb").alias("c"), edge.alias("e")))
        best = stash(ends.groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct(), "forest-picked")
        if not best.limit(1).count():
            drop_stash(best)
            break
        picked.append(best)
        parts = stash(connected_components(best.select(F.col("ca").alias("a"), F.col("cb").alias("b"))), "forest-parts")
        of = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias(f"new_{c}"))  # noqa: E731, B023
        moved = now.join(of("ca"), "ca").join(of("cb"), "cb").where("new_ca <> new_cb")
        moved = moved.select("cost", "a", "b", F.least("new_ca", "new_cb").alias("ca"), F.greatest("new_ca", "new_cb").alias("cb"))
        then = stash(moved.groupBy("ca", "cb").agg(F.min(F.struct("cost", "a", "b")).alias("e")).select("e.*", "ca", "cb"), "forest-edges")
        drop_stash(now, parts)
        now = then
    weight = (-F.col("cost") if largest else F.col("cost")).alias("weight")
    return (stashed_union(picked) if picked else now).select("a", "b", weight).distinct()


def strong_components(edges: DataFrame | EdgeLayout) -> DataFrame:
    """node, scc: the smallest node of the strongly connected component.

    Nodes that no edge enters, or none leaves, are components of their own and go first, again and again.  Then every node gets
    the smallest node that reaches it as its colour; within a colour, the nodes that reach that smallest one back are
    its component.  The rest goes on, without edges between different colours.

    Edges lie in buckets and are written anew only when colours part them; a round exchanges messages, and no table is broadcast.
    """
    layout = edges if isinstance(edges, EdgeLayout) else EdgeLayout(edges.select("src", "dst").distinct())
    loops = layout.by_src.where("src = dst").select(F.col("src").alias("node"), F.lit(1).alias("own"))
    own = F.coalesce("own", F.lit(0))
    degrees = layout.nodes.join(loops.hint("shuffle_hash"), "node", "left").select("node", (F.col("in_degree") - own).alias("into"), (F.col("out_degree") - own).alias("out"))
    now = stash_bucketed(degrees, "scc_nodes", "node", spread=False)
    done = [stash(now.select("node", F.lit(None).cast("long").alias("scc")).limit(0), "scc")]
    while True:
        now = _trimmed(layout, now, done)
        if not now.limit(1).count():
            break
        colours = _colours(layout.by_src, now)
        of = lambda end, c: colours.select(F.col("node").alias(end), F.col("colour").alias(c)).hint("shuffle_hash")  # noqa: E731, B023
        same = layout.by_src.where("src <> dst").join(of("src", "c"), "src").join(of("dst", "d"), "dst").where("c = d")
        inside = stash_bucketed(same.select("src", "dst"), "scc_inside", "dst", spread=False)
        reached = _back(inside, colours)
        done.append(stash(reached.where("scc is not null").select("node", "scc"), "scc"))
        rest = reached.where("scc is null").select("node")
        end = lambda name: rest.withColumnRenamed("node", name).hint("shuffle_hash")  # noqa: E731, B023
        left = EdgeLayout(inside.join(end("dst"), "dst", "left_semi").join(end("src"), "src", "left_semi"))
        counts = rest.join(left.nodes.hint("shuffle_hash"), "node", "left").select("node", F.coalesce("in_degree", F.lit(0)).alias("into"), F.coalesce("out_degree", F.lit(0)).alias("out"))
        then = stash_bucketed(counts, "scc_nodes", "node", spread=False)
        drop_stash(now, colours, inside, reached)
        if layout is not edges:
            layout.drop()
        layout, now = left, then
    drop_stash(now)
    if layout is not edges:
        layout.drop()
    return stashed_union(done)


def _trimmed(layout: EdgeLayout, now: DataFrame, done: list[DataFrame]) -> DataFrame:
    """The nodes that are left (node, into, out: edges from and to other nodes that are left); those that go are added to ``done``."""
    while True:
        going = now.where("into = 0 or out = 0").select("node")
        alone = stash(going.select("node", F.col("node").alias("scc")), "scc")
        if not alone.limit(1).count():
            drop_stash(alone)
            return now
        done.append(alone)
        on = layout.by_src.join(going.withColumnRenamed("node", "src").hint("shuffle_hash"), "src").select(F.col("dst").alias("node"), F.lit(1).alias("into"), F.lit(0).alias("out"))
        back = layout.by_dst.join(going.withColumnRenamed("node", "dst").hint("shuffle_hash"), "dst").select(F.col("src").alias("node"), F.lit(0).alias("into"), F.lit(1).alias("out"))
        lost = on.union(back).groupBy("node").agg(F.sum("into").alias("less_into"), F.sum("out").alias("less_out"))
        kept = now.where("into > 0 and out > 0").join(lost.hint("shuffle_hash"), "node", "left")
        then = kept.select("node", (F.col("into") - F.coalesce("less_into", F.lit(0))).alias("into"), (F.col("out") - F.coalesce("less_out", F.lit(0))).alias("out"))
        then = stash_bucketed(then, "scc_nodes", "node", spread=False)
        drop_stash(now)
        now = then


def _colours(by_src: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, colour: the smallest node from which the node is reached (itself included).  Nodes that changed send."""
    now = stash_bucketed(nodes.select("node", F.col("node").alias("colour"), F.lit(True).alias("new")), "scc_colours", "node", spread=False)
    while True:
        changed = now.where("new").select(F.col("node").alias("src"), "colour").hint("shuffle_hash")
        sent = by_src.join(changed, "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("got"))
        better = F.coalesce(F.col("got") < F.col("colour"), F.lit(False))
        then = now.join(sent.hint("shuffle_hash"), "node", "left").select("node", F.least("colour", "got").alias("colour"), better.alias("new"))
        then = stash_bucketed(then, "scc_colours", "node", spread=False)
        drop_stash(now)
        now = then
        if not now.where("new").limit(1).count():
            return now


def _back(by_dst: DataFrame, colours: DataFrame) -> DataFrame:
    """node, scc: the colour of each node that reaches its colour's smallest node along edges, which lie within one colour; null of others."""
    root = F.col("node") == F.col("colour")
    now = stash_bucketed(colours.select("node", F.when(root, F.col("colour")).alias("scc"), root.alias("new")), "scc_back", "node", spread=False)
    while now.where("new").limit(1).count():
        front = now.where("new").select(F.col("node").alias("dst"), "scc").hint("shuffle_hash")
        met = by_dst.join(front, "dst").groupBy(F.col("src").alias("node")).agg(F.min("scc").alias("got"))
        new = F.col("scc").isNull() & F.col("got").isNotNull()
        then = now.join(met.hint("shuffle_hash"), "node", "left").select("node", F.coalesce("scc", "got").alias("scc"), new.alias("new"))
        then = stash_bucketed(then, "scc_back", "node", spread=False)
        drop_stash(now)
        now = then
    return now


def citation_order(edges: DataFrame) -> DataFrame:
    """node, scc, level: every node, with works that cite each other in a circle at one level.  An edge between components
    leads to a higher level, the length of the longest chain of components that ends there."""
    layout = EdgeLayout(edges.select("src", "dst").distinct())
    parts = stash_bucketed(strong_components(layout), "order_parts", "node")
    of = lambda end, c: parts.select(F.col("node").alias(end), F.col("scc").alias(c)).hint("shuffle_hash")
    between = layout.by_src.join(of("src", "s"), "src").join(of("dst", "d"), "dst").where("s <> d")
    levels = topological_levels(between.select(F.col("s").alias("src"), F.col("d").alias("dst"))).select(F.col("node").alias("scc"), "level")
    sizes = parts.groupBy("scc").agg(F.count(F.lit(1)).alias("times"))
    about = stash(sizes.join(levels.hint("shuffle_hash"), "scc", "left").select("scc", F.coalesce("level", F.lit(0)).alias("level"), "times"), "order-levels")
    # a component may hold most of the nodes
    out = stash(join_by(parts, about, "scc", F.col("times"), parts.count()).select("node", "scc", "level"), "order")
    drop_stash(parts, about)
    layout.drop()
    return out
