"""Entity resolution: duplicate policies, clusters, election, fusion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions import identifiers as idf
from citeloom.functions import records
from citeloom.functions.text import confidence, fuzzy_ratio
from citeloom.operators.components import connected_components
from citeloom.operators.corpus import fuse
from citeloom.sources.scratch import stash

TITLE_THRESHOLD = 95
YEAR_GAP = 1
Policy = Callable[[DataFrame], DataFrame]


def _stars(keyed: DataFrame, reason: Column, value: float) -> DataFrame:
    """(first, later) pairs of equal keys.  The first of a key is a pre-aggregated minimum, so a hot key is no bottleneck."""
    first = keyed.groupBy("key").agg(F.min("seq").alias("primary_seq"))
    return keyed.join(first, "key").where("seq <> primary_seq").select("primary_seq", F.col("seq").alias("secondary_seq"), reason.alias("reason"), F.lit(value).alias("confidence"))


def namespace_policy(namespace: str) -> Policy:
    """Equal identifiers of a namespace."""

    def run(works: DataFrame) -> DataFrame:
        keyed = works.select("seq", idf.find_namespace(F.col("ids"), namespace).alias("key")).where("key is not null")
        return _stars(keyed, F.lit(_reason(namespace)), 1.0)

    run.namespace = namespace
    return run


def _reason(namespace: str) -> str:
    return f"{namespace}_match" if namespace in ("doi", "arxiv", "openalex", "s2", "pubmed") else "fingerprint"


def _identifier_pairs(works: DataFrame, policies: list[tuple[int, str, str]]) -> DataFrame:
    """The pairs of several namespace policies (rank, name, namespace) from one pass over the records."""
    key = lambda ns: idf.find_namespace(F.col("ids"), ns).alias("key")
    each = [F.struct(F.lit(rank).alias("policy_rank"), F.lit(name).alias("policy"), F.lit(_reason(ns)).alias("reason"), key(ns)) for rank, name, ns in policies]
    keyed = works.select("seq", F.explode(F.array(*each)).alias("k")).select("seq", "k.*").where("key is not null")
    first = keyed.groupBy("policy_rank", "key").agg(F.min("seq").alias("primary_seq"))
    pairs = keyed.join(first, ["policy_rank", "key"]).where("seq <> primary_seq")
    return pairs.select("primary_seq", F.col("seq").alias("secondary_seq"), "reason", F.lit(1.0).alias("confidence"), "policy", "policy_rank")


def fingerprint_policy(works: DataFrame) -> DataFrame:
    """Equal MD5 of the first 50 characters of the normalized title, the first author's family name and the year."""
    family = F.coalesce(F.get("authors", F.lit(0))["family"], F.lit("")) if "authors" in works.columns else F.lit("")
    title, year = F.coalesce(F.substring("norm_title", 1, 50), F.lit("")), F.coalesce(F.col("year").cast("string"), F.lit(""))
    key = F.when((title != "") | (family != "") | (year != ""), F.md5(F.concat_ws(":", title, family, year).cast("binary")))
    return _stars(works.select("seq", key.alias("key")).where("key is not null"), F.lit("fingerprint"), 0.90)


def neighbours(works: DataFrame) -> DataFrame:
    """Each record and the next one in the order of (norm_title, seq), without one task that holds them all.

    Records are range-partitioned; inside a range the next record is a window, and the seams are the last record of a
    range with the first of the next one that has any: two rows per range.
    """
    narrow = works.where("norm_title <> ''").select("seq", "norm_title", "year")
    parts = int(works.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stash(narrow.repartitionByRange(parts, "norm_title", "seq").withColumn("part", F.spark_partition_id()), "neighbours")
    row = F.struct("norm_title", "seq", "year")
    inside = ranged.withColumn("next", F.lead(row).over(Window.partitionBy("part").orderBy("norm_title", "seq"))).where("next is not null").select(row.alias("a"), F.col("next").alias("b"))
    ends = ranged.groupBy("part").agg(F.min(row).alias("first"), F.max(row).alias("last"))
    seams = ends.withColumn("b", F.lead("first").over(Window.orderBy("part"))).where("b is not null").select(F.col("last").alias("a"), "b")
    return inside.union(seams)


def title_fuzzy_policy(threshold: int = TITLE_THRESHOLD, year_gap: int = YEAR_GAP) -> Policy:
    """Neighbours in title order whose titles are alike and whose years, if both are known, are close."""

    def run(works: DataFrame) -> DataFrame:
        near = neighbours(works).where(F.col("a.year").isNull() | F.col("b.year").isNull() | (F.abs(F.col("a.year") - F.col("b.year")) <= year_gap))
        # lengths bound the ratio from above, so most pairs need no edit distance
        longest, shortest = F.greatest(F.length("a.norm_title"), F.length("b.norm_title")), F.least(F.length("a.norm_title"), F.length("b.norm_title"))
        rated = near.where(F.round(shortest / longest * 100) >= threshold).withColumn("ratio", fuzzy_ratio(F.col("a.norm_title"), F.col("b.norm_title"))).where(F.col("ratio") >= threshold)
        return rated.select(F.col("a.seq").alias("primary_seq"), F.col("b.seq").alias("secondary_seq"), F.lit("title_fuzzy").alias("reason"), confidence(F.col("ratio")).alias("confidence"))

    return run


#: Production order of the policies.
POLICIES: dict[str, Policy] = {**{ns: namespace_policy(ns) for ns in ("doi", "arxiv", "openalex", "s2", "pubmed")}, "title_fuzzy": title_fuzzy_policy()}


def select_policies(names: list[str] | None = None) -> dict[str, Policy]:
    """All if none are named; unknown names are left out."""
    known = POLICIES | {"fingerprint": fingerprint_policy, "ieee": namespace_policy("ieee"), "doaj": namespace_policy("doaj")}
    return {n: known[n] for n in names if n in known} if names else dict(POLICIES)


def detect(works: DataFrame, policies: dict[str, Policy]) -> DataFrame:
    """policy_rank, policy, primary_seq, secondary_seq, reason, confidence of every policy; those on identifiers share one pass."""
    ranked = [(rank, name, run, getattr(run, "namespace", None)) for rank, (name, run) in enumerate(policies.items())]
    parts = [run(works).withColumn("policy", F.lit(name)).withColumn("policy_rank", F.lit(rank)) for rank, name, run, ns in ranked if ns is None]
    if by_id := [(rank, name, ns) for rank, name, _, ns in ranked if ns is not None]:
        parts.insert(0, _identifier_pairs(works, by_id))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def policy_stats(pairs: DataFrame) -> DataFrame:
    """New pairs by policy: a pair, in either direction, counts for the first policy that finds it."""
    low, high = F.least("primary_seq", "secondary_seq"), F.greatest("primary_seq", "secondary_seq")
    first = pairs.groupBy(low.alias("a"), high.alias("b")).agg(F.min(F.struct("policy_rank", "policy")).alias("p"))
    return first.groupBy(F.col("p.policy").alias("policy")).agg(F.count(F.lit(1)).alias("pairs"))


def clusters(works: DataFrame, pairs: DataFrame) -> DataFrame:
    """seq, cluster_id (its smallest seq) for every record."""
    parts = connected_components(pairs.select(F.col("primary_seq").alias("a"), F.col("secondary_seq").alias("b")))
    return works.select("seq").join(parts, works["seq"] == parts["node"], "left").select("seq", F.coalesce("component", "seq").alias("cluster_id"))


def score(works: DataFrame) -> Column:
    """Completeness plus source priority; absent columns count as missing."""
    has = lambda c, ok: ok if c in works.columns else F.lit(False)
    doi = F.exists("ids", lambda x: x["ns"] == "doi")
    orcid = has("authors", F.exists(F.coalesce("authors", F.array()), lambda a: a["orcid"].isNotNull())) if "authors" in works.columns else F.lit(False)
    return records.completeness(doi, F.col("abstract"), has("venue", F.col("venue").isNotNull()) if "venue" in works.columns else F.lit(False), (F.size("authors") > 0) if "authors" in works.columns else F.lit(False), F.col("year"), F.col("cited_by_count"), F.col("is_retracted"), orcid) + records.priority(F.col("source_provider"))


def election_order(works: DataFrame) -> list[Column]:
    """Ascending keys: best score, then a DOI, then the earlier retrieval (if known), then arrival."""
    doi = F.exists("ids", lambda x: x["ns"] == "doi")
    return [-score(works), (~doi).cast("int"), *([F.col("retrieved_at")] if "retrieved_at" in works.columns else []), F.col("seq")]


def elect(works: DataFrame, members: DataFrame) -> DataFrame:
    """cluster_id, representative, size, score: pre-aggregated, a cluster is never gathered in one task."""
    keyed = members.join(works.withColumn("_score", score(works)), "seq")
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(election_order(works))])
    return keyed.groupBy("cluster_id").agg(F.min_by("seq", key).alias("representative"), F.count(F.lit(1)).alias("cluster_size"), F.max("_score").alias("score"))


def fuse_clusters(works: DataFrame, members: DataFrame) -> DataFrame:
    """A record per cluster: the representative's, gaps filled from the other members in order of arrival."""
    chosen = elect(works, members).select(F.col("cluster_id").alias("_c"), "representative")
    joined = members.join(works, "seq").join(chosen, F.col("cluster_id") == F.col("_c")).drop("_c")
    order = [F.when(F.col("seq") == F.col("representative"), 0).otherwise(1), F.col("seq")]
    return fuse(joined, "cluster_id", order).drop("representative")


def deduplicate(works: DataFrame, policies: list[str] | None = None) -> DataFrame:
    """seq, cluster_id.  What the policies compare is worked out once and kept as a narrow table; texts are not read again."""
    compared = [c for c in ("seq", "ids", "norm_title", "year", "authors") if c in works.columns]
    narrow = stash(works.select(*compared), "dedup-keys")
    return clusters(narrow, detect(narrow, select_policies(policies)))


def summary(works: DataFrame, members: DataFrame) -> DataFrame:
    """input_count, unique_count, duplicates_removed."""
    return members.agg(F.count(F.lit(1)).alias("input_count"), F.count_distinct("cluster_id").alias("unique_count")).withColumn("duplicates_removed", F.col("input_count") - F.col("unique_count"))


# ---------------------------------------------------------------- what a cluster can be asked

def clusters_of_ids(works: DataFrame, members: DataFrame, wanted: DataFrame) -> DataFrame:
    """ns, value, cluster_id: the cluster with a member that has the wanted identifier (ns, value), in any namespace."""
    held = works.select("seq", F.explode("ids").alias("id")).select("seq", "id.ns", "id.value")
    return held.join(wanted.select("ns", "value").distinct(), ["ns", "value"]).join(members, "seq").select("ns", "value", "cluster_id").distinct()


def non_representatives(works: DataFrame, members: DataFrame) -> DataFrame:
    """cluster_id, seq of the members that are neither the representative nor have its primary identifier's value."""
    named = members.join(works.select("seq", idf.primary(F.col("ids"))["value"].alias("name")), "seq")
    chosen = elect(works, members).select("cluster_id", "representative")
    heads = named.join(chosen, "cluster_id").where("seq = representative").select("cluster_id", "representative", F.col("name").alias("head"))
    return named.join(heads, "cluster_id").where("seq <> representative and not coalesce(name = head, false)").select("cluster_id", "seq")


def cluster_ids(works: DataFrame, members: DataFrame, namespace: str) -> DataFrame:
    """cluster_id, n, values: the distinct identifiers of a namespace in a cluster (the first of each member), sorted."""
    held = works.select("seq", idf.find_namespace(F.col("ids"), namespace).alias("value")).where("value is not null")
    return held.join(members, "seq").groupBy("cluster_id").agg(F.sort_array(F.collect_set("value")).alias("values")).withColumn("n", F.size("values").cast("long"))


def has_identifier(elected: DataFrame, works: DataFrame, namespace: str) -> DataFrame:
    """cluster_id, found: whether the representative has an identifier of the namespace."""
    held = works.select(F.col("seq").alias("representative"), idf.find_namespace(F.col("ids"), namespace).isNotNull().alias("found"))
    return elected.join(held, "representative").select("cluster_id", "found")


def involving(pairs: DataFrame, seq: int) -> DataFrame:
    """The duplicates in which a record takes part, on either side."""
    return pairs.where((F.col("primary_seq") == seq) | (F.col("secondary_seq") == seq))


def connected(members: DataFrame, asked: DataFrame) -> DataFrame:
    """a, b, connected: whether two records are in one cluster; records without a cluster are connected with themselves alone."""
    of = lambda c: members.select(F.col("seq").alias(c), F.col("cluster_id").alias(f"_{c}"))
    return asked.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce(F.col("_a") == F.col("_b"), F.col("a") == F.col("b")).alias("connected"))
