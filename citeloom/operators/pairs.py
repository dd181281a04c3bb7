"""Pairs of items that many keys hold together: co-citation and bibliographic coupling, safe for hubs.

Items go with an array of their partners to the task that counts them.  A key with more than ``BLOCK`` items is cut into
blocks, and each pair of blocks (i <= j) is a join key of its own, so no array is longer than a block.  With a least weight, pairs are found by a filter of prefixes: keys have one
global order, from those with the fewest items to hubs, and two items that share w keys share one outside of
the last w - 1 keys of either; so each item leaves out its w - 1 largest keys, and only pairs found by the rest are counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.operators.skew import HUBS, join_by
from citeloom.sources.scratch import drop_stash, stash

BLOCK = 2048
#: Pairs that a task counts.
PAIRS_A_TASK = 1 << 21
#: Weights at which the search for the strongest partners is tried, before all pairs of the nodes that are left.
THRESHOLDS = (16, 4)


def _sizes(rows: DataFrame) -> tuple[int, int]:
    """Items of the largest key, and pairs of all keys."""
    n = F.col("n")
    found = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).agg(F.max(n), F.sum((n * (n - 1) / 2).cast("decimal(38,0)"))).first()
    return found[0] or 0, int(found[1] or 0)


def _in_blocks(rows: DataFrame) -> DataFrame:
    """key, item, least (the key's smallest item), blocks, block of every row (key, item); blocks are 1 for most keys."""
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("item").alias("least"))
    total = rows.count()
    sized = join_by(rows, sizes, "key", F.col("n"), total).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    return sized.select("key", "item", "least", "blocks", F.pmod(F.hash("item"), F.col("blocks")).alias("block"))


def _fanned(rows: DataFrame, largest: int, tasks: int, both: bool) -> DataFrame:
    """item, least, others: each item of a key with the larger ones of that key (``both``: with all others), in one array."""
    larger = F.slice("items", F.col("at") + 2, F.size("items"))
    rest = F.concat(F.slice("items", F.lit(1), F.col("at")), larger) if both else larger
    if largest <= BLOCK:
        lists = rows.repartition(tasks, "key").groupBy("key").agg(F.sort_array(F.collect_list("item")).alias("items"))
        fanned = lists.select(F.posexplode("items").alias("at", "item"), F.col("items")[0].alias("least"), "items")
        return fanned.select("item", "least", rest.alias("others")).where(F.size("others") > 0)
    lists = _in_blocks(rows).groupBy("key", "block").agg(F.first("blocks").alias("blocks"), F.first("least").alias("least"), F.sort_array(F.collect_list("item")).alias("items"))
    lists = stash(lists, "pairs-lists")  # read three times
    inside = lists.repartition(tasks, "key", "block").select(F.posexplode("items").alias("at", "item"), "least", "items").select("item", "least", rest.alias("others"))
    left = lists.select("key", "least", F.col("items").alias("x"), F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j")).where("i < j")
    right = lists.select("key", F.col("items").alias("y"), F.explode(F.sequence(F.lit(0), F.col("block"))).alias("i"), F.col("block").alias("j")).where("i < j")
    met = left.repartition(tasks, "key", "i", "j").join(right, ["key", "i", "j"])
    sides = [met.select(F.explode(own).alias("item"), "least", F.col(other).alias("others")) for own, other in (("x", "y"), ("y", "x"))]
    across = sides[0].union(sides[1])
    if not both:
        across = across.select("item", "least", F.filter("others", lambda o: o > F.col("item")).alias("others"))
    return inside.union(across).where(F.size("others") > 0)


def _counted(rows: DataFrame, both: bool = False, sizes: tuple[int, int] | None = None) -> DataFrame:
    """a, b, weight, star (a is the smallest item of one of their keys): pairs of items (a < b, or ``both`` ways) and their keys.

    An item is sent with the array of its partners to the task that counts all of them, so a pair costs its bare id in the
    shuffle; there are as many tasks as the number of pairs asks for.  Items with more than a task's share of pairs are dealt
    over several tasks by partner.
    """
    largest, total = sizes or _sizes(rows)
    total *= 2 if both else 1
    shuffles = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(shuffles, -(-total // PAIRS_A_TASK))
    fanned, by = _fanned(rows, largest, max(shuffles, tasks // 4), both), ["a"]
    fanned = fanned.withColumnRenamed("item", "a")
    longest = rows.groupBy("item").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if longest * largest > PAIRS_A_TASK:
        of_keys = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        load = join_by(rows, of_keys, "key", F.col("n"), rows.count()).groupBy(F.col("item").alias("a")).agg(F.sum("n").alias("load"))
        # loads add up to 2 * total at most, so these are fewer than HUBS
        hot = F.broadcast(load.where(F.col("load") > max(PAIRS_A_TASK, 2 * total // HUBS)).select("a", F.ceil(F.col("load") / PAIRS_A_TASK).cast("int").alias("parts")))
        dealt = fanned.join(hot, "a", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        own = F.when(F.col("parts").isNull(), F.col("others")).otherwise(F.filter("others", lambda o: F.pmod(F.hash(o), F.col("parts")) == F.col("part")))
        fanned, by = dealt.select("a", "part", "least", own.alias("others")), ["a", "part"]
    # the sum by pair needs no exchange of its own, since its rows lie together by a
    lone = fanned.select(*by, (F.col("a") == F.col("least")).alias("star"), "others").repartition(tasks, *by)
    each = lone.select(*by, "star", F.explode("others").alias("b"))
    return each.groupBy(*by, "b").agg(F.count(F.lit(1)).alias("weight"), F.max("star").alias("star")).select("a", "b", "weight", "star")


def _partners(some: DataFrame, rows: DataFrame) -> DataFrame:
    """a (an item of ``some``) and b (any other of ``rows``), once for every key they share; both are (key, item)."""
    dealt = _in_blocks(rows)
    blocks = dealt.groupBy("key").agg(F.max("blocks").alias("blocks"))
    asked = some.join(blocks, "key").select("key", F.col("item").alias("a"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    return asked.join(dealt.select("key", F.col("item").alias("b"), "block"), ["key", "block"]).where("a <> b").select("a", "b")


def _prefixes(rows: DataFrame, weight: int) -> DataFrame:
    """``rows`` without the ``weight`` - 1 largest keys of each item."""
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    sized = join_by(rows, sizes, "key", F.col("n"), rows.count())
    # a limit on ranks is applied before the shuffle too, so an item of many keys sends few
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("n"), F.desc("key")))
    last = sized.withColumn("rank", rank).where(F.col("rank") <= weight - 1).select("key", "item")
    return rows.join(last, ["key", "item"], "left_anti")


def _weighed(pairs: DataFrame, rows: DataFrame, weight: int) -> DataFrame:
    """a, b, weight of distinct pairs, counted over all keys."""
    of_a = pairs.join(rows.select(F.col("item").alias("a"), "key"), "a")
    both = of_a.join(rows.select(F.col("item").alias("b"), "key"), ["b", "key"])
    return both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight")).where(F.col("weight") >= weight)


def _heavy(rows: DataFrame, weight: int) -> DataFrame:
    """The rows of items with at least ``weight`` keys: no other is in a pair of that weight."""
    enough = rows.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= weight).select("item")
    return rows.join(enough, "item", "left_semi").select("key", "item")


def _rows(edges: DataFrame, by: str, item: str) -> DataFrame:
    return edges.select(F.col(by).alias("key"), F.col(item).alias("item"))


def together(edges: DataFrame, by: str, item: str, min_weight: int = 1) -> DataFrame:
    """a < b and the number of keys that hold both, for pairs of at least ``min_weight``; edges are distinct."""
    rows = _rows(edges, by, item)
    rows = stash(_heavy(rows, min_weight) if min_weight > 1 else rows, "pairs-rows")  # read several times
    sizes = _sizes(rows)
    if min_weight > 1 and sizes[0] > BLOCK:
        return _weighed(_counted(_prefixes(rows, min_weight)).select("a", "b"), rows, min_weight)
    counted = _counted(rows, sizes=sizes).select("a", "b", "weight")
    return counted.where(F.col("weight") >= min_weight) if min_weight > 1 else counted


def backbone(edges: DataFrame, by: str, item: str) -> DataFrame:
    """The pairs of ``together`` that a spanning forest of largest weight (equal ones in the order of a, b) can hold.

    A pair (x, y) of weight 1 whose only key has a smaller item m is left out: (m, x) and (m, y) weigh as much or more and come
    before it, so they close a circle in which it is the last.  Pairs of weight 2 or more and those with a key's smallest item stay.
    """
    rows = stash(_rows(edges, by, item), "pairs-rows")
    return _counted(rows).where((F.col("weight") > 1) | F.col("star")).select("a", "b", "weight")


def strongest(edges: DataFrame, by: str, item: str, n: int, thresholds: tuple[int, ...] = THRESHOLDS) -> DataFrame:
    """node, rank, other, weight: the ``n`` partners of each node with the most shared keys, ties to the smaller.

    Exact, with early stop: a node with ``n`` partners of a threshold's weight or more needs none below it, so each round of
    a lower threshold asks for the nodes that are left only.  Without hubs all pairs are counted at once.
    """
    rows = stash(_rows(edges, by, item), "strongest-rows")
    sizes = _sizes(rows)
    if sizes[0] <= BLOCK:
        found = _counted(rows, both=True, sizes=sizes)
        rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("weight"), "b"))
        return found.withColumn("rank", rank).where(F.col("rank") <= n).select(F.col("a").alias("node"), "rank", F.col("b").alias("other"), "weight")
    open_ = rows.select("item").distinct()
    held, done = [rows], None
    for weight in (*thresholds, 1):
        some = rows.join(open_, "item", "left_semi").select("key", "item")
        if weight > 1:
            fit = _prefixes(_heavy(rows, weight), weight)
            found = _partners(fit.join(open_, "item", "left_semi").select("key", "item"), fit).distinct()
            found = _weighed(found, rows, weight)
        else:
            found = _partners(some, rows).groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight"))
        rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("weight"), "b"))
        ranked = stash(found.withColumn("rank", rank).where(F.col("rank") <= n).select(F.col("a").alias("node"), "rank", F.col("b").alias("other"), "weight"), "strongest-round")
        full = ranked.groupBy("node").agg(F.count(F.lit(1)).alias("found")).where(F.col("found") >= n).select("node")
        settled = ranked.join(full, "node", "left_semi") if weight > 1 else ranked
        done = settled if done is None else done.union(settled)
        if weight == 1:
            break
        left = stash(open_.join(full.withColumnRenamed("node", "item"), "item", "left_anti"), "strongest-open")
        held.append(left)
        open_ = left
        if not left.limit(1).count():
            break
    out = stash(done.select("node", "rank", "other", "weight"), "strongest")
    drop_stash(*held)
    return out
