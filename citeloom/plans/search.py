"""Federated search: union of the sources' records, statistics, deduplication, cache."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.functions.text import normalize_title
from citeloom.operators import dedup
from citeloom.operators.corpus import union_sources
from citeloom.sources import payloads
from citeloom.sources.scratch import stash
from citeloom.sources.store import ResultCache


@dataclass
class SearchResult:
    records: DataFrame
    stats: DataFrame
    total_raw: int
    from_cache: bool


def with_seq(records: DataFrame) -> DataFrame:
    """A total order: the sources as they were united, then the place in the source.  Partitions are numbered through, so
    numbers are unique however many there are.  Written once, because ids of rows have to stay."""
    return stash(records.withColumn("seq", F.monotonically_increasing_id()), "search")


def first_of_each(raw: DataFrame, n: int) -> DataFrame:
    """The first ``n`` records of each source, by ``seq`` of ``with_seq``: its upper bits number the partitions, the lower ones the
    rows in one.  Only the partitions' counts are put in order, a row each; a source's records are never brought together."""
    part = F.shiftright("seq", 33)
    counts = raw.groupBy("source_provider", part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy("source_provider").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("source_provider").alias("_source"), "_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    met = raw.join(F.broadcast(starts), (F.col("source_provider") == F.col("_source")) & (part == F.col("_part")))
    return met.where(F.col("_start") + F.col("seq").bitwiseAND((1 << 33) - 1) < n).select(*raw.columns)


def aggregate(frames: dict[str, DataFrame], max_results: int = 100, failed: dict[str, str] | None = None, cache: ResultCache | None = None, key: str | None = None, policies: list[str] | None = None, latency: DataFrame | None = None, spark: SparkSession | None = None) -> SearchResult:
    """Records of each source (at most ``max_results``), united in registration order and resolved.

    ``failed`` are sources that gave nothing and why: they get a row in the statistics, the others' records stay.
    ``latency`` (source_provider, latency_ms) joins the statistics.  If no source gave an answer the result has no records.
    """
    if cache is not None and key is not None and (hit := cache.get(key)) is not None:
        return SearchResult(hit, hit.groupBy("source_provider").agg(F.count(F.lit(1)).alias("result_count")), hit.count(), True)
    order = [s for s in payloads.NORMALIZERS if s in frames]
    spark = spark or (next(iter(frames.values())).sparkSession if frames else SparkSession.active())
    if not order:
        nothing = spark.createDataFrame([], payloads.FIELDS["openalex"])
        frames, order = {"openalex": payloads.normalize(nothing, "openalex")}, ["openalex"]
    raw = with_seq(union_sources([frames[s] for s in order]))
    raw = first_of_each(raw, max_results).withColumn("norm_title", normalize_title(F.col("title")))
    stats = raw.groupBy("source_provider").agg(F.count(F.lit(1)).alias("result_count")).withColumn("skip_reason", F.lit(None).cast("string"))
    if failed:
        stats = stats.unionByName(spark.createDataFrame([(s, 0, why) for s, why in sorted(failed.items())], "source_provider string, result_count long, skip_reason string"))
    if latency is not None:
        stats = stats.join(latency.groupBy("source_provider").agg(F.max("latency_ms").alias("latency_ms")), "source_provider", "left")
    fused = dedup.fuse_clusters(raw, dedup.deduplicate(raw, policies))
    if cache is not None and key is not None:
        fused = cache.put(key, fused)
    return SearchResult(fused, stats, raw.count(), False)


def federated(fetched: DataFrame, max_results: int = 100, cache: ResultCache | None = None, key: str | None = None, policies: list[str] | None = None) -> SearchResult:
    """From the rows of the search source (source, page, body, error, latency_ms) to the aggregated result.

    Bodies are parsed, normalized and united; a source whose rows are all errors is in the statistics with its reason.
    """
    fetched = stash(fetched, "fetched")
    whole = fetched.where("body is not null")
    known = {r["source"] for r in whole.select("source").distinct().collect()}  # one row a source
    why = {r["source"]: r["error"] for r in fetched.groupBy("source").agg(F.max("error").alias("error")).collect() if r["source"] not in known}
    frames = {s: payloads.normalize(payloads.items_of(whole.where(F.col("source") == s).select("body"), s), s) for s in payloads.NORMALIZERS if s in known}
    latency = fetched.groupBy(F.col("source").alias("source_provider")).agg(F.max("latency_ms").alias("latency_ms"))
    return aggregate(frames, max_results, why, cache, key, policies, latency, fetched.sparkSession)
