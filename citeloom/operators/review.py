"""Screening, provenance and run statistics: latest decisions, progress, conflicts, flow counts, failure gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_decisions(log: DataFrame) -> DataFrame:
    """The newest row of each (project, stage, work); equal times go by the higher decision_id.  No window: a maximum."""
    key = F.struct("decided_at", "decision_id")
    rest = [c for c in log.columns if c not in ("project", "stage", "work")]
    return log.groupBy("project", "stage", "work").agg(F.max_by(F.struct(*rest), key).alias("r")).select("project", "stage", "work", "r.*")


def screening_progress(latest: DataFrame, total: DataFrame) -> DataFrame:
    """project, stage, total, screened, include, exclude, maybe, conflict, remaining, percent (conflicts do not count)."""
    n = lambda d: F.count_if(F.col("decision") == d).alias(d)
    done = latest.groupBy("project", "stage").agg(n("include"), n("exclude"), n("maybe"), n("conflict"), F.count(F.lit(1)).alias("screened"))
    base = F.col("total") - F.col("conflict")
    out = done.join(total, "project").withColumn("remaining", F.col("total") - F.col("screened"))
    return out.withColumn("percent", F.when(base > 0, F.round((F.col("screened") - F.col("conflict")) * 100.0 / base, 2)).otherwise(0.0))


def conflict_routing(votes: DataFrame) -> DataFrame:
    """project, work, voters, route: agree, soft (a majority), hard (none), or none for one voter."""
    each = votes.groupBy("project", "work", "decision").agg(F.count(F.lit(1)).alias("n"))
    per = each.groupBy("project", "work").agg(F.sum("n").alias("voters"), F.max("n").alias("top"), F.count(F.lit(1)).alias("kinds"))
    route = F.when(F.col("voters") == 1, "none").when(F.col("kinds") == 1, "agree").when(2 * F.col("top") > F.col("voters"), "soft").otherwise("hard")
    return per.select("project", "work", "voters", route.alias("route"))


def failure_gates(stats: DataFrame, required: list[str]) -> DataFrame:
    """run, failures, soft (one or more), hard (three or more, or a required source)."""
    failed = ~F.col("ok")
    out = stats.groupBy("run").agg(F.count_if(failed).alias("failures"), F.coalesce(F.bool_or(failed & F.col("source").isin(required)), F.lit(False)).alias("_required"))
    return out.select("run", "failures", (F.col("failures") >= 1).alias("soft"), ((F.col("failures") >= 3) | F.col("_required")).alias("hard"))


def flow_counts(works: DataFrame, members: DataFrame, latest: DataFrame) -> DataFrame:
    """step, n: identified by source, duplicates removed, screened, excluded by stage, included."""
    count = F.count(F.lit(1)).alias("n")
    identified = works.groupBy(F.concat(F.lit("identified:"), F.col("source_provider")).alias("step")).agg(count)
    duplicates = members.agg((F.count(F.lit(1)) - F.count_distinct("cluster_id")).alias("n")).select(F.lit("duplicates_removed").alias("step"), "n")
    screened = latest.where("stage = 'title_abstract'").agg(count).select(F.lit("screened").alias("step"), "n")
    excluded = latest.where("decision = 'exclude'").groupBy(F.concat(F.lit("excluded:"), F.col("stage")).alias("step")).agg(count)
    included = latest.where("decision = 'include' and stage = 'final'").agg(count).select(F.lit("included").alias("step"), "n")
    return identified.union(duplicates).union(screened).union(excluded).union(included)


def source_badges(members: DataFrame, works: DataFrame) -> DataFrame:
    """cluster_id, sources: distinct sources of a cluster's records."""
    return members.join(works.select("seq", "source_provider"), "seq").groupBy("cluster_id").agg(F.count_distinct("source_provider").alias("sources"))


def first_success(attempts: DataFrame) -> DataFrame:
    """work, source, attempts: the earliest successful attempt of each work (null if none), and how many were made."""
    key = F.struct("attempted_at", "attempt_id")
    return attempts.groupBy("work").agg(F.min_by("source", F.when(F.col("ok"), key)).alias("source"), F.count(F.lit(1)).alias("attempts"))


def excluded_by_reason(latest: DataFrame, reason: str = "reason") -> DataFrame:
    """stage, reason, n: records whose newest decision excludes them; without a reason they count as unspecified."""
    why = F.coalesce(F.nullif(F.trim(F.col(reason)), F.lit("")), F.lit("unspecified")).alias("reason")
    return latest.where("decision = 'exclude'").groupBy("stage", why).agg(F.count(F.lit(1)).alias("n"))
