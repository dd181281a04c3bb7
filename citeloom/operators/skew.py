"""Joins on keys that may be hot: keys that hold more than their share are broadcast, and there are few of those at any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.sources.scratch import stash

#: A key with over 1 / ``HUBS`` of all rows is a hub, so there are fewer than ``HUBS`` hubs.
HUBS = 1000


def join_by(rows: DataFrame, about: DataFrame, key: str, times: Column, total: int) -> DataFrame:
    """``rows`` joined with ``about`` (one row a key).  ``times`` is the number of ``rows`` that a row of ``about`` meets,
    and ``total`` at least their sum; the keys with the most of them are broadcast, the rest have few rows each."""
    hub = times > max(total // HUBS, HUBS)
    hubs = F.broadcast(about.where(hub))
    return rows.join(hubs, key).union(rows.join(hubs.select(key), key, "left_anti").join(about.where(~hub), key))


def semi_join(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``rows`` whose key ``wanted`` (one row a key) has, however many rows hold one key."""
    times = stash(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_times")), "times")
    total = times.agg(F.sum("_times")).first()[0] or 0
    return join_by(rows, times.join(wanted.select(key), key), key, F.col("_times"), total).select(*rows.columns)
