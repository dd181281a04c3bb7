"""Citation-graph operators over an edge table (src cites dst) and, where isolated nodes matter, a node table.

Iterative operators write each round's state to the shared folder, so plans stay short; edges lie in buckets (``EdgeLayout``)
and are not exchanged again.  Operators with a limit on rounds raise if they have not settled by then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.operators import pairs
from citeloom.sources.scratch import drop_stash, stash, stash_bucketed, stashed_union

#: Items of a node's list in an ``EdgeLayout``; nodes with more have several.
LONG_LIST = 4096
#: Core numbers are sent by every node while more than one node in so many falls, or has too little support.
MANY_FALL, MANY_SHORT = 16, 8


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()


def add_works(works: DataFrame, key: str = "primary_key", order: str = "seq") -> DataFrame:
    """Nodes by primary identifier, the last write of each; records without one are left out."""
    return works.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.max_by(c, order).alias(c) for c in works.columns if c != key])


def record_citations(nodes: DataFrame, edges: DataFrame, strict: bool = False) -> DataFrame:
    """Distinct edges whose citing node is known; the cited one may be external.  ``strict`` raises for unknown ones."""
    known = edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").distinct()
    if strict and edges.join(nodes.select(F.col("node").alias("src")), "src", "left_anti").limit(1).count():
        raise ValueError("an edge's citing work is not in the graph")
    return known


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])


def involving(edges: DataFrame, node: int | str) -> DataFrame:
    return edges.where((F.col("src") == node) | (F.col("dst") == node))


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, in_degree, out_degree, hub, authority: one pass over the edges' ends."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    if nodes is not None:
        ends = ends.union(nodes.select("node", F.lit(0).alias("o"), F.lit(0).alias("i")))
    counted = ends.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    total = F.col("in_degree") + F.col("out_degree") + 1
    return counted.withColumn("hub", F.col("out_degree") / total).withColumn("authority", F.col("in_degree") / total)


def co_citation(edges: DataFrame, min_weight: int = 1) -> DataFrame:
    """a < b and the number of works that cite both."""
    return pairs.together(edges, "src", "dst", min_weight)


def coupling(edges: DataFrame, min_weight: int = 1) -> DataFrame:
    """a < b and the number of references that they share."""
    return pairs.together(edges, "dst", "src", min_weight)


def co_citation_backbone(edges: DataFrame) -> DataFrame:
    """The rows of ``co_citation`` that its spanning forest of largest weight can hold."""
    return pairs.backbone(edges, "src", "dst")


def top_co_cited(edges: DataFrame, n: int = 10) -> DataFrame:
    """node, rank, other, weight: the works most often cited together with each one."""
    return pairs.strongest(edges, "src", "dst", n)


def top_coupled(edges: DataFrame, n: int = 10) -> DataFrame:
    """node, rank, other, weight: the works that share the most references with each one."""
    return pairs.strongest(edges, "dst", "src", n)


class EdgeLayout:
    """Edges in buckets by their source and, where asked for, by their target, and a node table in the same buckets.

    A round of an iterative operator joins its state with the edges where they lie; only messages are exchanged.
    """

    def __init__(self, edges: DataFrame):
        plain = edges.select("src", "dst")
        self.spark = edges.sparkSession
        self.by_src = stash_bucketed(plain, "edges_by_src", "src")
        self.nodes = stash_bucketed(degrees(self.by_src).select("node", "in_degree", "out_degree"), "edge_nodes", "node")
        self._by_dst: DataFrame | None = None
        self._out_lists: DataFrame | None = None
        self._in_lists: DataFrame | None = None

    @property
    def by_dst(self) -> DataFrame:
        if self._by_dst is None:
            self._by_dst = stash_bucketed(self.by_src, "edges_by_dst", "dst")
        return self._by_dst

    @property
    def out_lists(self) -> DataFrame:
        """src, items: the works cited, in the buckets of ``by_src``; a row a node, not one an edge."""
        if self._out_lists is None:
            self._out_lists = self._listed(self.by_src, "src", "dst", "out_degree")
        return self._out_lists

    @property
    def in_lists(self) -> DataFrame:
        """dst, items: the citing works, in the buckets of ``by_dst``."""
        if self._in_lists is None:
            n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            self._in_lists = self._listed(self.by_src.repartition(n, "dst"), "dst", "src", "in_degree")
        return self._in_lists

    def _listed(self, rows: DataFrame, key: str, item: str, degree: str) -> DataFrame:
        """A hub has several lists, of about ``LONG_LIST`` items."""
        sized = rows.join(self.nodes.select(F.col("node").alias(key), F.ceil(F.col(degree) / LONG_LIST).cast("int").alias("lists")).hint("shuffle_hash"), key)
        listed = sized.groupBy(key, F.pmod(F.hash(item), F.col("lists")).alias("list")).agg(F.collect_list(item).alias("items"))
        return stash_bucketed(listed.select(key, "items"), f"lists_by_{key}", key, spread=False)

    def drop(self) -> None:
        drop_stash(self.by_src, self.nodes, *[made for made in (self._by_dst, self._out_lists, self._in_lists) if made is not None])


def _layout(edges: DataFrame | EdgeLayout) -> EdgeLayout:
    return edges if isinstance(edges, EdgeLayout) else EdgeLayout(edges)


def pagerank(edges: DataFrame | EdgeLayout, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6, start: DataFrame | None = None) -> DataFrame:
    """node, rank.  Nodes without references spread their rank evenly (or over ``start``, for a personalized rank).

    A round exchanges the shares that are sent, added up by target before; edges and ranks stay in their buckets, and edges are
    looked up in a table of their bucket's nodes, not sorted.
    """
    layout = _layout(edges)
    n = layout.nodes.count()
    if not n:
        return layout.spark.createDataFrame([], "node long, rank double")
    out = F.when(F.col("out_degree") > 0, F.col("out_degree")).alias("out")
    if start is None:
        home = layout.nodes.select("node", out, F.lit(1.0 / n).alias("home"))
    else:
        m = max(start.select("node").distinct().count(), 1)
        home = layout.nodes.select("node", out).join(start.select("node").distinct().withColumn("in_start", F.lit(1.0 / m)), "node", "left").select("node", "out", F.coalesce("in_start", F.lit(0.0)).alias("home"))
    now = stash_bucketed(home.select("node", "out", "home", F.col("home").alias("rank"), F.lit(0.0).alias("before")), "pagerank", "node", spread=False)
    for _ in range(rounds):
        dangling = now.where("out is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        shares = now.where("out is not null").select(F.col("node").alias("src"), (F.col("rank") / F.col("out")).alias("share"))
        sent = layout.by_src.join(shares.hint("shuffle_hash"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum("share").alias("got"))
        rank = (1 - damping) * F.col("home") + damping * (F.coalesce("got", F.lit(0.0)) + dangling * F.col("home"))
        then = stash_bucketed(now.join(sent.hint("shuffle_hash"), "node", "left").select("node", "out", "home", rank.alias("rank"), F.col("rank").alias("before")), "pagerank", "node", spread=False)
        moved = then.agg(F.sum(F.abs(F.col("rank") - F.col("before")))).first()[0]
        drop_stash(now)
        now = then
        if moved < tolerance:
            break
    if layout is not edges:
        layout.drop()
    return now.select("node", "rank")


def hits(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """node, hub, authority (each of Euclidean length 1)."""
    layout = EdgeLayout(edges)
    now = stash_bucketed(layout.nodes.select("node", F.lit(1.0).alias("hub"), F.lit(1.0).alias("authority")), "hits", "node", spread=False)
    for _ in range(rounds):
        hubs = now.where("hub <> 0").select(F.col("node").alias("src"), "hub").hint("shuffle_hash")
        auth = layout.by_src.join(hubs, "src").groupBy(F.col("dst").alias("node")).agg(F.sum("hub").alias("authority"))
        auth_sums = stash_bucketed(auth, "hits_a", "node", spread=False)
        auth = _unit(auth_sums, "authority")
        known = auth.select(F.col("node").alias("dst"), "authority").hint("shuffle_hash")
        hub = layout.by_dst.join(known, "dst").groupBy(F.col("src").alias("node")).agg(F.sum("authority").alias("hub"))
        hub_sums = stash_bucketed(hub, "hits_h", "node", spread=False)
        hub = _unit(hub_sums, "hub")
        then = now.select("node").join(hub.hint("shuffle_hash"), "node", "left").join(auth.hint("shuffle_hash"), "node", "left")
        then = stash_bucketed(then.select("node", F.coalesce("hub", F.lit(0.0)).alias("hub"), F.coalesce("authority", F.lit(0.0)).alias("authority")), "hits", "node", spread=False)
        drop_stash(now, auth_sums, hub_sums)
        now = then
    layout.drop()
    return now


def _unit(scores: DataFrame, column: str) -> DataFrame:
    length = scores.agg(F.sqrt(F.sum(F.col(column) ** 2))).first()[0]
    return scores.withColumn(column, F.col(column) / F.lit(length or 1.0))


def k_core(edges: DataFrame | EdgeLayout, k: int, by: str = "in", max_rounds: int = 1000) -> DataFrame:
    """node, degree of what is left when nodes of degree under k ("in" or "total") are peeled off again and again.

    Only the nodes that go in a round send messages, along their edges; edges are never rewritten.
    """
    layout = _layout(edges)
    degree = F.col("in_degree") if by == "in" else F.col("in_degree") + F.col("out_degree")
    now = stash_bucketed(layout.nodes.select("node", degree.alias("degree"), F.lit(False).alias("gone")), "kcore", "node", spread=False)
    for _ in range(max_rounds):
        going = now.where(~F.col("gone") & (F.col("degree") < k)).select("node")
        if not going.limit(1).count():
            break
        lost = layout.by_src.join(going.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"))
        if by != "in":
            lost = lost.union(layout.by_dst.join(going.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node")))
        less = lost.groupBy("node").agg(F.count(F.lit(1)).alias("less"))
        gone = F.col("gone") | (F.col("degree") < k)
        then = stash_bucketed(now.join(less, "node", "left").select("node", (F.col("degree") - F.coalesce("less", F.lit(0))).alias("degree"), gone.alias("gone")), "kcore", "node", spread=False)
        drop_stash(now)
        now = then
    else:
        raise RuntimeError(f"the core has not settled in {max_rounds} rounds")
    if layout is not edges:
        layout.drop()
    return now.where(~F.col("gone")).select("node", "degree")


def core_numbers(edges: DataFrame | EdgeLayout, max_rounds: int = 1000, rounds: int | None = None) -> DataFrame:
    """node, core: the largest k for which the node stays when nodes cited by fewer than k of the rest are peeled off.

    ``rounds``: no more than so many rounds, all nodes at once in each; numbers that have not settled by then are upper bounds.

    A node's number is at most the largest h such that h of its citing works have a number of h or more, beginning with the
    degrees; lowering numbers to that settles on the core numbers.  While many nodes fall, each sends its number along its
    edges.  After that each node keeps its support, the citing works whose number is not below its own: only nodes with too
    little of it read their citing works again, and only nodes that changed send.  Numbers are counted by value before they
    are gathered, so a hub gets no list.
    """
    layout = _layout(edges)
    n = layout.nodes.count()
    now, every = layout.nodes.select("node", F.col("in_degree").alias("core")), True
    for done in range(1, max_rounds + 1):
        if every:
            sends = now.select(F.col("node").alias("src"), F.col("core").alias("value"))
            citing = layout.out_lists.join(sends.hint("shuffle_hash"), "src").select(F.explode("items").alias("node"), "value")
        else:
            short = now.where("short").select("node", F.col("core").alias("old"))
            citing = layout.in_lists.join(short.withColumnRenamed("node", "dst").hint("shuffle_hash"), "dst").select(F.col("dst").alias("node"), "old", F.explode("items").alias("src"))
            citing = citing.join(now.select(F.col("node").alias("src"), "core").hint("shuffle_hash"), "src").select("node", F.least("core", "old").alias("value"))
        seen = citing.groupBy("node", "value").agg(F.count(F.lit(1)).alias("n"))
        above = F.sum("n").over(Window.partitionBy("node").orderBy(F.desc("value")))
        # of the values that give the largest h none is below h, and at the least of them all citing works with h or more are counted
        best = seen.withColumn("above", above).groupBy("node").agg(F.max(F.struct(F.least("value", "above").alias("h"), "above")).alias("best"))
        h, support = F.coalesce("best.h", F.lit(0)).cast("long"), F.coalesce("best.above", F.lit(0)).cast("long")
        if every:
            met = now.select("node", F.col("core").alias("old")).join(best.hint("shuffle_hash"), "node", "left")
            own = changed = stash_bucketed(met.select("node", "old", h.alias("core"), support.alias("support")), "cores_all", "node", spread=False)
        else:
            changed = stash(short.join(best.hint("shuffle_hash"), "node", "left").select("node", "old", h.alias("core"), support.alias("support")), "cores-changed")
            again = changed.select("node", F.col("core").alias("h"), F.col("support").alias("again")).hint("shuffle_hash")
            own = now.join(again, "node", "left").select("node", F.coalesce("h", "core").alias("core"), F.coalesce("again", "support").alias("support"))
        if done == rounds:
            now = own
            break
        fell = changed.where("core < old").select(F.col("node").alias("src"), "old", F.col("core").alias("new"))
        if every:
            falling = fell.count()
            if not falling or falling * MANY_FALL > n:
                drop_stash(now)
                now = own
                if not falling:
                    break
                continue
        sent = layout.out_lists.join(fell.hint("shuffle_hash"), "src").select(F.explode("items").alias("node"), "old", "new").groupBy("node", "old", "new").agg(F.count(F.lit(1)).alias("n"))
        lost = own.select("node", "core").hint("shuffle_hash").join(sent, "node").where("old >= core and new < core").groupBy("node").agg(F.sum("n").alias("lost"))
        left = own.join(lost.hint("shuffle_hash"), "node", "left").select("node", "core", (F.col("support") - F.coalesce("lost", F.lit(0))).alias("support"))
        then = stash_bucketed(left.select("node", "core", "support", (F.col("support") < F.col("core")).alias("short")), "cores", "node", spread=False)
        drop_stash(now, changed)
        now = then
        shorts = now.where("short").count()
        if not shorts:
            break
        every = shorts * MANY_SHORT > n
    else:
        raise RuntimeError(f"core numbers have not settled in {max_rounds} rounds")
    if layout is not edges:
        layout.drop()
    return now.select("node", "core")


def bfs_levels(edges: DataFrame | EdgeLayout, start: DataFrame, max_depth: int | None = None) -> DataFrame:
    """node, depth, parent: shortest directed distance from the start nodes, and the smallest predecessor.

    Each level is a table of its own: what was found before is read, never written again.
    """
    layout = _layout(edges)
    levels = [stash(start.select(F.col("node").cast("long").alias("node")).distinct().select("node", F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent")), "bfs")]
    while max_depth is None or len(levels) <= max_depth:
        front = levels[-1].select(F.col("node").alias("src"))
        found = layout.by_src.join(front, "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        found = found.join(stashed_union(levels).select("node"), "node", "left_anti")
        new = stash(found.select("node", F.lit(len(levels)).alias("depth"), "parent"), "bfs")
        if not new.limit(1).count():
            drop_stash(new)
            break
        levels.append(new)
    if layout is not edges:
        layout.drop()
    return stashed_union(levels)


def shortest_path(edges: DataFrame, source: int, target: int) -> list[int] | None:
    """The nodes of one shortest directed path, or None; the walk back reads one row a step."""
    levels = bfs_levels(edges, edges.sparkSession.createDataFrame([(source,)], "node long"))
    path, at = [], target
    while at is not None:
        row = levels.where(F.col("node") == at).select("parent").first()
        if row is None:
            return None
        path.append(at)
        at = row[0]
    return path[::-1]


def snowball(edges: DataFrame, seeds: DataFrame, depth: int = 1, forward: int = 100, backward: int = 100) -> DataFrame:
    """node, depth, is_new for each step: works that cite the frontier (at most ``forward`` each, smallest first) and works
    that it cites (at most ``backward`` each); what is already known is flagged and not followed again."""
    known = stash(seeds.select("node").distinct(), "snowball-known")
    front = known
    rounds: DataFrame | None = None
    for step in range(1, min(depth, 5) + 1):
        citing = _limited(edges.join(front.select(F.col("node").alias("dst")), "dst"), "dst", "src", forward)
        cited = _limited(edges.join(front.select(F.col("node").alias("src")), "src"), "src", "dst", backward)
        found = citing.union(cited).distinct().join(known.withColumn("old", F.lit(True)), "node", "left").select("node", F.lit(step).alias("depth"), F.col("old").isNull().alias("is_new"))
        found = stash(found, "snowball")
        rounds = found if rounds is None else rounds.union(found)
        front = found.where("is_new").select("node")
        if not front.limit(1).count():
            break
        known = stash(known.union(front), "snowball-known")
    return rounds


def _limited(pairs: DataFrame, by: str, item: str, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(by).orderBy(item))
    return pairs.withColumn("_r", rank).where(F.col("_r") <= n).select(F.col(item).alias("node"))


def convergence(round_: DataFrame) -> DataFrame:
    """depth, found, new, convergence_ratio (share that was known before)."""
    return round_.groupBy("depth").agg(F.count(F.lit(1)).alias("found"), F.sum(F.col("is_new").cast("long")).alias("new_works")).withColumn("convergence_ratio", (F.col("found") - F.col("new_works")) / F.col("found"))


def triangles(edges: DataFrame) -> DataFrame:
    """node, triangles (undirected).  Edges point from lower to higher (degree, id), which bounds a node's list of ends.

    An edge travels to its end with the ends that follow there in the start's list, and these are met with the end's own list: a row
    an edge, not one a pair; lists to a hub are short, since few nodes follow it.
    """
    und = edges.select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).where("x <> y").distinct()
    deg = und.select(F.col("x").alias("n")).union(und.select(F.col("y").alias("n"))).groupBy("n").agg(F.count(F.lit(1)).alias("d"))
    with_x = und.join(deg.select(F.col("n").alias("x"), F.col("d").alias("dx")), "x").join(deg.select(F.col("n").alias("y"), F.col("d").alias("dy")), "y")
    x, y = F.struct(F.col("dx").alias("d"), F.col("x").alias("n")), F.struct(F.col("dy").alias("d"), F.col("y").alias("n"))
    out = with_x.select(F.least(x, y)["n"].alias("s"), F.greatest(x, y).alias("t"))
    near = F.transform(F.sort_array(F.collect_list("t")), lambda t: t["n"])
    lists = stash(out.groupBy("s").agg(near.alias("near")), "triangle-lists")
    asked = lists.select("s", "near", F.posexplode("near").alias("i", "t")).where(F.col("i") + 1 < F.size("near"))
    asked = asked.select("s", "t", F.slice("near", F.col("i") + 2, F.size("near")).alias("others"))
    met = asked.join(lists.select(F.col("s").alias("t"), F.col("near").alias("theirs")).hint("shuffle_hash"), "t")
    one = lambda node, n: F.struct(node.alias("node"), n.cast("long").alias("n"))
    each = lambda both: F.concat(F.array(one(F.col("s"), F.size(both)), one(F.col("t"), F.size(both))), F.transform(both, lambda t: one(t, F.lit(1))))
    # within an array of one array, so that lists are met once
    found = F.flatten(F.transform(F.filter(F.array(F.array_intersect("others", "theirs")), lambda both: F.size(both) > 0), each))
    return met.select(F.explode_outer(found).alias("e")).where("e is not null").groupBy("e.node").agg(F.sum("e.n").alias("triangles"))


def local_clustering(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, clustering: the share of a node's pairs of neighbours (undirected) that are neighbours themselves."""
    und = edges.select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).where("x <> y").distinct()
    deg = und.select(F.explode(F.array("x", "y")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("d"))
    share = F.when(F.col("d") > 1, 2.0 * F.coalesce("triangles", F.lit(0)) / (F.col("d") * (F.col("d") - 1))).otherwise(0.0)
    every = nodes_of(edges) if nodes is None else nodes.select("node")
    return every.join(deg, "node", "left").join(triangles(edges), "node", "left").select("node", share.alias("clustering"))


def network_metrics(edges: DataFrame) -> DataFrame:
    """node_count, edge_count, density, avg_clustering: one row."""
    edges = stash(edges.select("src", "dst"), "metrics-edges")  # read several times
    a = local_clustering(edges).agg(F.count(F.lit(1)).alias("node_count"), F.avg("clustering").alias("avg_clustering"))
    b = edges.agg(F.count(F.lit(1)).alias("edge_count"))
    n = F.col("node_count")
    return a.join(b, F.lit(True)).select("node_count", "edge_count", F.when(n > 1, F.col("edge_count") / (n * (n - 1))).otherwise(0.0).alias("density"), "avg_clustering")


def analyze(edges: DataFrame, rounds: int = 100, tolerance: float = 1e-6, core_rounds: int | None = None) -> DataFrame:
    """node, in_degree, out_degree, rank, core, clustering: every measure from one layout of the edges, a row per node."""
    layout = EdgeLayout(edges)
    ranks, cores = pagerank(layout, rounds=rounds, tolerance=tolerance), core_numbers(layout, rounds=core_rounds)
    local = local_clustering(layout.by_src, layout.nodes)
    out = stash(layout.nodes.join(ranks, "node").join(cores, "node").join(local, "node"), "analysis")
    layout.drop()
    return out


def influential(edges: DataFrame, n: int = 20) -> DataFrame:
    return pagerank(edges).orderBy(F.desc("rank"), "node").limit(n)


def topological_levels(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """node, level: longest chain of citations that ends at the node, for acyclic graphs; nodes on cycles are left out.

    Nodes that nothing left cites go, and send along their edges, which stay in their buckets; no table is broadcast.
    """
    layout = EdgeLayout(edges.select("src", "dst").distinct())
    none = F.lit(None).cast("int")
    level_of = lambda left, level, t: F.coalesce(level, F.when(left == 0, F.lit(t)))
    first = layout.nodes.select("node", F.col("in_degree").alias("left"), level_of(F.col("in_degree"), none, 0).alias("level"))
    now = stash_bucketed(first, "topo", "node", spread=False)
    for level in range(max_rounds):
        going = now.where(F.col("level") == level).select(F.col("node").alias("src"))
        if not going.limit(1).count():
            break
        sent = layout.by_src.join(going.hint("shuffle_hash"), "src").groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("less"))
        left = F.col("left") - F.coalesce("less", F.lit(0))
        then = now.join(sent.hint("shuffle_hash"), "node", "left").select("node", left.alias("left"), level_of(left, F.col("level"), level + 1).alias("level"))
        then = stash_bucketed(then, "topo", "node", spread=False)
        drop_stash(now)
        now = then
    else:
        raise RuntimeError(f"the levels have not settled in {max_rounds} rounds")
    layout.drop()
    return now.where("level is not null").select("node", "level")
