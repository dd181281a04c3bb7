"""Betweenness: for a batch of sources at once, levels of path counts forward and dependencies back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.operators.graph import EdgeLayout, _layout
from citeloom.sources.scratch import drop_stash, stash, stashed_union

#: An edge that is asked along sends a question and an answer.
ASKING = 2


def betweenness(edges: DataFrame | EdgeLayout, sources: DataFrame) -> DataFrame:
    """node, betweenness: over the given sources, the share of shortest directed paths from each to any other node that pass
    through the node.  With all nodes as sources it is the exact betweenness; with some it is their part of the sum.

    State is keyed by (source, node), so one run serves all sources.  A round goes along the edges from whichever side has
    fewer pairs: from those reached last, or from those not reached yet (back: from the lower level, or from the upper one), which ask
    along their edges and are answered.  So levels that hold most pairs do not send along all their edges.  Sources that are no
    nodes of the graph add nothing.
    """
    layout = _layout(edges)
    first = sources.select("node").distinct().join(layout.nodes.select("node"), "node", "left_semi")
    pair = ["source", "node"]
    levels = [stash(first.select(F.col("node").alias("source"), "node", F.lit(1.0).alias("paths")), "paths")]
    sizes = [levels[0].count()]
    left = sizes[0] * (layout.nodes.count() - 1)
    rest: DataFrame | None = None  # pairs not reached, once they are few
    while left:
        if ASKING * left < sizes[-1]:
            if rest is None:
                every = levels[0].select("source").crossJoin(layout.nodes.select("node"))
                rest = stash(every.join(stashed_union(levels).select(*pair), pair, "left_anti"), "rest")
            asked = layout.by_dst.join(rest.withColumnRenamed("node", "dst"), "dst").select("source", "src", F.col("dst").alias("node"))
            met = asked.join(levels[-1].select("source", F.col("node").alias("src"), "paths"), ["source", "src"]).groupBy(*pair).agg(F.sum("paths").alias("paths"))
        else:
            front = levels[-1].select("source", F.col("node").alias("src"), "paths")
            met = layout.by_src.join(front, "src").groupBy("source", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
            met = met.join(stashed_union(levels).select(*pair), pair, "left_anti") if rest is None else met.join(rest, pair, "left_semi")
        new = stash(met, "paths")
        if not (n := new.count()):
            drop_stash(new)
            break
        levels.append(new)
        sizes.append(n)
        left -= n
        if rest is not None:
            fewer = stash(rest.join(new.select(*pair), pair, "left_anti"), "rest")
            drop_stash(rest)
            rest = fewer
    # dependencies, from the last level back to the first
    below = stash(levels[-1].select("source", "node", "paths", F.lit(0.0).alias("share")), "shares")
    shares = [below]
    for level, size, size_below in zip(levels[-2::-1], sizes[-2::-1], sizes[:0:-1]):
        parts = below.select("source", F.col("node").alias("dst"), ((1 + F.col("share")) / F.col("paths")).alias("part"))
        if ASKING * size < size_below:
            asked = layout.by_src.join(level.select("source", F.col("node").alias("src")), "src").select("source", "src", "dst")
            sent = asked.join(parts, ["source", "dst"])
        else:
            sent = layout.by_dst.join(parts, "dst")
        got = sent.groupBy("source", F.col("src").alias("node")).agg(F.sum("part").alias("part"))
        below = stash(level.join(got, pair, "left").select("source", "node", "paths", (F.col("paths") * F.coalesce("part", F.lit(0.0))).alias("share")), "shares")
        shares.append(below)
    total = stashed_union(shares).where("source <> node").groupBy("node").agg(F.sum("share").alias("share"))
    out = stash(layout.nodes.select("node").join(total, "node", "left").select("node", F.coalesce("share", F.lit(0.0)).alias("betweenness")), "betweenness")
    drop_stash(*levels, *shares, *([rest] if rest is not None else []))
    if layout is not edges:
        layout.drop()
    return out
