"""Places, ranks and runs over a whole table in one order, with no window that one task would have to hold.

Rows are range-partitioned and sorted; a row's place is its place in the range plus the rows of the ranges before.  There is one
row per range for those offsets, so they are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.text import fuzzy_ratio
from citeloom.operators.skew import join_by
from citeloom.sources.scratch import stash



def _ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` sorted in ranges, written, with _at (the range's number, then the place in it) and _part."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return stash(held, "ranged").withColumn("_part", F.shiftright("_at", 33))


def _before(ranged: DataFrame, amount: Column) -> DataFrame:
    """_part, _before: the amount of all ranges before; a row per range."""
    sums = ranged.groupBy("_part").agg(amount.alias("_n"))
    running = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    return F.broadcast(sums.select("_part", F.coalesce(running, F.lit(0)).alias("_before")))


def with_position(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` with position: 1 for the first row in the order, which has to be total."""
    ranged = _ranged(df, order)
    inside = F.col("_at") - F.shiftleft(F.col("_part"), 33)
    return ranged.join(_before(ranged, F.count(F.lit(1))), "_part").withColumn("position", F.col("_before") + inside + 1).drop("_at", "_part", "_before")


def with_running(df: DataFrame, order: list[Column], value: str) -> DataFrame:
    """``df`` with running: the sum of ``value`` (null: 0) up to and with the row."""
    ranged = _ranged(df, order)
    own = F.sum(F.coalesce(value, F.lit(0))).over(Window.partitionBy("_part").orderBy("_at"))
    return ranged.withColumn("_own", own).join(_before(ranged, F.coalesce(F.sum(value), F.lit(0))), "_part").withColumn("running", F.col("_before") + F.col("_own")).drop("_at", "_part", "_before", "_own")


def ranked(df: DataFrame, value: str, key: str, within: str, descending: bool = True, tiles: int = 100) -> DataFrame:
    """``df`` with what SQL's windows over (PARTITION BY within ORDER BY value, key) give: place, rank, percent_rank, cume_dist
    (of the value; equal values are peers) and tile (ntile over place).  Groups and peers of any size are spread out."""
    by = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_first()
    placed = stash(with_position(df, [F.col(within), by, F.col(key)]).withColumn("_group", F.struct(within)).withColumn("_peer", F.struct(within, value)), "ranked")
    count = F.count(F.lit(1))
    groups = placed.groupBy("_group").agg(count.alias("_n"), F.min("position").alias("_start"))
    peers = placed.groupBy("_peer").agg(count.alias("_m"), F.min("position").alias("_first"))
    total = placed.count()
    rows = join_by(join_by(placed, groups, "_group", F.col("_n"), total), peers, "_peer", F.col("_m"), total)
    place, rank, n = F.col("position") - F.col("_start") + 1, F.col("_first") - F.col("_start") + 1, F.col("_n")
    size, more = F.expr(f"_n div {tiles}"), F.expr(f"_n % {tiles}")
    at = F.col("place") - 1
    in_large = more * (size + 1)
    tile = F.when(at < in_large, F.floor(at / (size + 1))).otherwise(more + F.floor((at - in_large) / F.greatest(size, F.lit(1)))) + 1
    out = rows.withColumn("place", place).withColumn("rank", rank)
    out = out.withColumn("percent_rank", F.when(n > 1, (F.col("rank") - 1) / (n - 1)).otherwise(0.0)).withColumn("cume_dist", (F.col("rank") + F.col("_m") - 1) / n).withColumn("tile", tile.cast("long"))
    return out.drop("_group", "_peer", "_n", "_start", "_m", "_first", "position")


def fuzzy_islands(works: DataFrame, threshold: int = 95, year_gap: int = 1) -> DataFrame:
    """island, first_seq, last_seq, size, year_from, year_to: runs of records, in the order of (norm_title, seq), of which
    each is like the one before it.  A run may go over any number of ranges: the count of breaks is carried across."""
    narrow = works.where("norm_title <> ''").select("seq", "norm_title", "year")
    ranged = _ranged(narrow, [F.col("norm_title"), F.col("seq")])
    row = F.struct("norm_title", "seq", "year")
    ends = ranged.groupBy("_part").agg(F.max(row).alias("last"))
    seams = F.broadcast(ends.select("_part", F.lag("last").over(Window.orderBy("_part")).alias("_seam")))
    inside = F.lag(row).over(Window.partitionBy("_part").orderBy("_at"))
    met = ranged.withColumn("_inside", inside).join(seams, "_part").withColumn("p", F.coalesce("_inside", "_seam"))
    longest, shortest = F.greatest(F.length("p.norm_title"), F.length("norm_title")), F.least(F.length("p.norm_title"), F.length("norm_title"))
    near = F.coalesce(F.abs(F.col("p.year") - F.col("year")) <= year_gap, F.lit(True)) & (F.round(shortest / longest * 100) >= threshold)
    like = F.when(F.col("p").isNotNull() & near, fuzzy_ratio(F.col("p.norm_title"), F.col("norm_title")) >= threshold).otherwise(F.lit(False))
    broken = stash(met.select("seq", "norm_title", "year", "_part", "_at", F.when(like, 0).otherwise(1).alias("_break")), "islands")
    own = F.sum("_break").over(Window.partitionBy("_part").orderBy("_at"))
    numbered = broken.withColumn("_own", own).join(_before(broken, F.sum("_break")), "_part").withColumn("island", F.col("_before") + F.col("_own"))
    order = F.struct("norm_title", "seq")
    return numbered.groupBy("island").agg(F.min_by("seq", order).alias("first_seq"), F.max_by("seq", order).alias("last_seq"), F.count(F.lit(1)).alias("size"), F.min("year").alias("year_from"), F.max("year").alias("year_to"))
