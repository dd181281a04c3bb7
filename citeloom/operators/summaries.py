"""Counts over grouping sets, and sketches of distinct values that are kept per source and merged later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Log 2 of a sketch's buckets; its relative standard error is about 1.04 / 2 ** (SKETCH_K / 2) or less.
SKETCH_K = 12


def cube(df: DataFrame, *columns: str) -> DataFrame:
    """The columns, level and n: rows of every combination of the columns (a column left out is null, its bit set in level)."""
    return df.cube(*columns).agg(F.grouping_id().cast("long").alias("level"), F.count(F.lit(1)).alias("n"))


def rollup(df: DataFrame, *columns: str) -> DataFrame:
    """As ``cube``, for the columns from the first on only."""
    return df.rollup(*columns).agg(F.grouping_id().cast("long").alias("level"), F.count(F.lit(1)).alias("n"))


def sketches(df: DataFrame, by: str, value: Column, k: int = SKETCH_K) -> DataFrame:
    """by, sketch: of the distinct values in each group; a few kilobytes, however many values there are."""
    return df.groupBy(by).agg(F.hll_sketch_agg(value, k).alias("sketch"))


def merged(tables: DataFrame, *by: str) -> DataFrame:
    """by ..., distinct_values: the estimate over all sketches of a group (or of all, without ``by``)."""
    return tables.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_values"))


def overview(works: DataFrame, members: DataFrame) -> DataFrame:
    """raw, unique_works, savings_percent: one row."""
    counts = members.agg(F.count(F.lit(1)).alias("raw"), F.count_distinct("cluster_id").alias("unique_works"))
    saved = F.when(F.col("raw") > 0, F.round((F.col("raw") - F.col("unique_works")) * 100.0 / F.col("raw"), 2)).otherwise(0.0)
    return counts.withColumn("savings_percent", saved)
