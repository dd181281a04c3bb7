"""Registered queries on persons, runs, ranks, merges, clusters, grouping sets and payload paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import identifiers as idf
from citeloom.functions import paths, records
from citeloom.functions.text import cluster_name, normalize_author
from citeloom.operators import arrival, dedup, ranks, review, summaries
from citeloom.operators.corpus import browse, shared_persons
from citeloom.plans.catalog import ELECT_SQL, FULL_CLUSTERS, IDS_SQL, LATEST_SQL, SCORE_SQL
from citeloom.plans.registry import registered, with_works
from citeloom.sources import records_io
from citeloom.sources.projection import AUTHORS_SQL, authored, decisions, table, work_authors, works

# ---------------------------------------------------------------- persons and merges

PERSONS_SQL = """persons AS (
  SELECT l_orderkey AS seq, l_linenumber AS position, p_name AS name, CASE WHEN p_partkey % 3 <> 0 THEN '0000-0000-0000-' || lpad(CAST(p_partkey % 400 AS VARCHAR), 4, '0') END AS orcid,
    trim(regexp_replace(regexp_replace(strip_accents(lower(p_name)), '[^a-z\\s]', '', 'g'), '\\s+', ' ', 'g')) AS normalized, o_orderstatus = 'F' AS mine
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
)"""


@registered(
    f"""WITH {PERSONS_SQL}, theirs AS (SELECT DISTINCT orcid, normalized FROM persons WHERE NOT mine)
SELECT DISTINCT seq, position, name, orcid FROM persons p WHERE mine AND (
  (orcid IS NOT NULL AND orcid IN (SELECT orcid FROM theirs WHERE orcid IS NOT NULL)) OR (orcid IS NULL AND normalized IN (SELECT normalized FROM theirs))
  OR (orcid IS NOT NULL AND normalized IN (SELECT normalized FROM theirs WHERE orcid IS NULL)))"""
)
def person_intersect(spark: SparkSession, d: str) -> DataFrame:
    """Authors of finished orders who are authors of others too: by ORCID where both have one, else by name."""
    parts = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"))
    number = F.lpad((F.col("p_partkey") % 400).cast("string"), 4, "0")
    people = parts.withColumn("orcid", F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("0000-0000-0000-"), number))).withColumn("normalized", normalize_author(F.col("name")))
    people = people.withColumnRenamed("p_partkey", "l_partkey")
    lines = authored(spark, d, "l_partkey")
    theirs = people.join(lines.where("not mine").select("l_partkey").distinct(), "l_partkey", "left_semi")
    shared = shared_persons(people, theirs).select("l_partkey", "name", "orcid")
    return lines.where("mine").join(shared, "l_partkey").select("seq", "position", "name", "orcid").distinct()


SIDE_SQL = "CASE WHEN source_provider IN ('crossref', 'openalex') THEN 0 ELSE 1 END"


@registered(
    with_works(
        "SELECT works.seq, coalesce(o.seq, works.seq) AS entry FROM works LEFT JOIN (SELECT f.seq, f.spot FROM f) g ON works.seq = g.seq LEFT JOIN o ON o.k = g.spot",
        IDS_SQL,
        f"""o AS (SELECT row_number() OVER (ORDER BY side, seq) AS k, seq, ids FROM (SELECT w.seq, {SIDE_SQL} AS side, list(i.ns || ':' || i.value) AS ids
  FROM works w JOIN wids i ON w.seq = i.seq WHERE (i.ns, i.value) IN (SELECT (ns, value) FROM wids GROUP BY ns, value HAVING count(*) > 1) GROUP BY ALL)),
f AS (
  SELECT 0::BIGINT AS k, []::STRUCT(id VARCHAR, spot BIGINT)[] AS state, NULL::BIGINT AS seq, NULL::BIGINT AS spot
  UNION ALL
  SELECT k, list_concat(state, [{{'id': x, 'spot': spot}} for x in ids]), seq, spot FROM (SELECT o.k, f.state, o.seq, o.ids, coalesce(list_min([s.spot for s in f.state if list_contains(o.ids, s.id)]), o.k) AS spot FROM f JOIN o ON o.k = f.k + 1)
)""",
        recursive=True,
    )
)
def merge_in_arrival_order(spark: SparkSession, d: str) -> DataFrame:
    """The corpus of two sources, then that of all others: which record each one is merged into."""
    side = F.when(F.col("source_provider").isin("crossref", "openalex"), 0).otherwise(1)
    return arrival.first_matches(works(spark, d), [side])


@registered(f"WITH {AUTHORS_SQL}, lists AS (SELECT seq, list(name ORDER BY position, name) AS a FROM authors GROUP BY 1) SELECT seq, a[1] AS first_author, a[-1] AS last_author, a[3] AS third_author, CAST(len(a) AS BIGINT) AS n, len(a) = 1 AS alone, substr(sha256(CAST(seq AS VARCHAR)), 1, 10) AS short_name FROM lists")
def author_lists(spark: SparkSession, d: str) -> DataFrame:
    """What a list of authors can be asked, and the repeatable short name of a work."""
    lists = work_authors(spark, d).groupBy("seq").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "name"))), lambda x: x["name"]).alias("a"))
    at = lambda k: F.try_element_at("a", F.lit(k))
    return lists.select("seq", at(1).alias("first_author"), at(-1).alias("last_author"), at(3).alias("third_author"), F.size("a").cast("long").alias("n"), (F.size("a") == 1).alias("alone"), cluster_name(F.col("seq")).alias("short_name"))


# ---------------------------------------------------------------- runs and ranks

@registered(
    with_works(
        "SELECT island, arg_min(seq, (norm_title, seq)) AS first_seq, arg_max(seq, (norm_title, seq)) AS last_seq, CAST(count(*) AS BIGINT) AS size, min(year) AS year_from, max(year) AS year_to FROM numbered GROUP BY island",
        """prior AS (SELECT seq, norm_title, year, lag(norm_title) OVER w AS p, lag(year) OVER w AS py FROM works WHERE norm_title <> '' WINDOW w AS (ORDER BY norm_title, seq)),
rated AS (SELECT *, CASE WHEN p IS NULL OR abs(year - py) > 1 OR round(least(length(p), length(norm_title)) / greatest(length(p), length(norm_title)) * 100) < 95 THEN 0 WHEN p = norm_title THEN 100 ELSE round((1 - levenshtein(p, norm_title)::DOUBLE / greatest(length(p), length(norm_title))) * 100) END AS ratio FROM prior),
numbered AS (SELECT *, CAST(sum(CASE WHEN ratio >= 95 THEN 0 ELSE 1 END) OVER (ORDER BY norm_title, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM rated)""",
    )
)
def fuzzy_islands(spark: SparkSession, d: str) -> DataFrame:
    return ranks.fuzzy_islands(works(spark, d))


@registered(
    with_works(
        """SELECT seq, year, coalesce(cited_by_count, 0) AS cited, CAST(row_number() OVER p AS BIGINT) AS place, CAST(rank() OVER (PARTITION BY year ORDER BY coalesce(cited_by_count, 0) DESC) AS BIGINT) AS rank,
  round(percent_rank() OVER (PARTITION BY year ORDER BY coalesce(cited_by_count, 0) DESC), 9) AS percent_rank, round(cume_dist() OVER (PARTITION BY year ORDER BY coalesce(cited_by_count, 0) DESC), 9) AS cume_dist, CAST(ntile(10) OVER p AS BIGINT) AS decile
FROM works WINDOW p AS (PARTITION BY year ORDER BY coalesce(cited_by_count, 0) DESC, seq)"""
    )
)
def citation_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Where a work stands among those of its year by citations."""
    w = works(spark, d).select("seq", "year", F.coalesce("cited_by_count", F.lit(0)).alias("cited"))
    r = ranks.ranked(w, "cited", "seq", "year", tiles=10)
    return r.select("seq", "year", "cited", "place", "rank", F.round("percent_rank", 9).alias("percent_rank"), F.round("cume_dist", 9).alias("cume_dist"), F.col("tile").alias("decile"))


@registered(with_works("SELECT seq, CAST(sum(coalesce(cited_by_count, 0)) OVER (ORDER BY coalesce(cited_by_count, 0) DESC, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running, round(sum(coalesce(cited_by_count, 0)) OVER (ORDER BY coalesce(cited_by_count, 0) DESC, seq ROWS UNBOUNDED PRECEDING) / (SELECT sum(cited_by_count) FROM works)::DOUBLE, 9) AS share FROM works"))
def citation_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share of all citations that the most cited works, down to this one, have."""
    w = works(spark, d).select("seq", F.coalesce("cited_by_count", F.lit(0)).alias("cited"))
    total = w.agg(F.sum("cited")).first()[0] or 0
    r = ranks.with_running(w, [F.desc("cited"), F.col("seq")], "cited")
    return r.select("seq", F.col("running").cast("long").alias("running"), F.round(F.col("running") / F.lit(float(total)), 9).alias("share"))


# ---------------------------------------------------------------- clusters

@registered(with_works("SELECT DISTINCT i.ns, i.value, m.cluster_id FROM wids i JOIN members m ON i.seq = m.seq WHERE (i.ns, i.value) IN (SELECT (ns, value) FROM wids JOIN works w ON wids.seq = w.seq WHERE w.is_retracted)", *FULL_CLUSTERS, IDS_SQL, recursive=True))
def cluster_of_ids(spark: SparkSession, d: str) -> DataFrame:
    """The clusters of all identifiers of retracted records."""
    w = works(spark, d)
    wanted = w.where("is_retracted").select(F.explode("ids").alias("id")).select("id.ns", "id.value")
    return dedup.clusters_of_ids(w, dedup.deduplicate(w), wanted)


_NAME_SQL = "coalesce({0}.doi, {0}.arxiv)"


@registered(
    with_works(
        f"SELECT m.cluster_id, m.seq FROM members m JOIN works w ON m.seq = w.seq JOIN elected e ON e.cluster_id = m.cluster_id AND e.place = 1 WHERE m.seq <> e.seq AND NOT coalesce({_NAME_SQL.format('w')} = {_NAME_SQL.format('e')}, false)",
        *FULL_CLUSTERS, ELECT_SQL, recursive=True,
    )
)
def non_representatives(spark: SparkSession, d: str) -> DataFrame:
    w = works(spark, d)
    return dedup.non_representatives(w, dedup.deduplicate(w))


@registered(with_works("SELECT m.cluster_id, string_agg(DISTINCT w.doi, '|' ORDER BY w.doi) AS dois, CAST(count(DISTINCT w.doi) AS BIGINT) AS n FROM members m JOIN works w ON m.seq = w.seq WHERE w.doi IS NOT NULL GROUP BY 1", *FULL_CLUSTERS, recursive=True))
def cluster_dois(spark: SparkSession, d: str) -> DataFrame:
    w = works(spark, d)
    return dedup.cluster_ids(w, dedup.deduplicate(w), "doi").select("cluster_id", F.array_join("values", "|").alias("dois"), "n")


@registered(with_works("SELECT p.primary_seq AS a, p.secondary_seq AS b, m.cluster_id = n.cluster_id AS connected FROM (SELECT seq AS primary_seq, lead(seq) OVER (ORDER BY seq) AS secondary_seq FROM works) p JOIN members m ON p.primary_seq = m.seq JOIN members n ON p.secondary_seq = n.seq", *FULL_CLUSTERS, recursive=True))
def cluster_connected(spark: SparkSession, d: str) -> DataFrame:
    """Whether a record and the one that arrived after it are the same work."""
    w = works(spark, d)
    placed = ranks.with_position(w.select("seq"), [F.col("seq")])
    after = placed.select(F.col("seq").alias("b"), (F.col("position") - 1).alias("position"))
    asked = placed.join(after, "position").select(F.col("seq").alias("a"), "b")
    return dedup.connected(dedup.deduplicate(w), asked)


@registered(with_works("SELECT CAST(count(*) AS BIGINT) AS raw, CAST(count(DISTINCT cluster_id) AS BIGINT) AS unique_works, round((count(*) - count(DISTINCT cluster_id)) * 100.0::DOUBLE / count(*), 2) AS savings_percent FROM members", *FULL_CLUSTERS, recursive=True))
def corpus_overview(spark: SparkSession, d: str) -> DataFrame:
    w = works(spark, d)
    return summaries.overview(w, dedup.deduplicate(w))


@registered(f"WITH {LATEST_SQL} SELECT stage, event_type AS reason, CAST(count(*) AS BIGINT) AS n FROM latest WHERE decision = 'exclude' GROUP BY ALL")
def prisma_reasons(spark: SparkSession, d: str) -> DataFrame:
    return review.excluded_by_reason(review.latest_decisions(decisions(spark, d)), "event_type")


# ---------------------------------------------------------------- browsing, grouping sets and sketches

@registered(with_works(f"SELECT seq, year, CAST({SCORE_SQL} AS INTEGER) AS completeness FROM works WHERE seq % 2 = 0 AND abstract IS NOT NULL AND {SCORE_SQL} >= 6 AND year >= 2005"))
def browse_complete(spark: SparkSession, d: str) -> DataFrame:
    """Open records with an abstract, since 2005, that are complete to six points at least."""
    w = works(spark, d)
    rated = w.withColumn("completeness", dedup.score(w) - records.priority(F.col("source_provider"))).withColumn("is_open_access", F.col("seq") % 2 == 0)
    return browse(rated, year_from=2005, open_access=True, has_abstract=True, min_completeness=6).select("seq", "year", "completeness")


_IDENTITY_SQL = "CASE WHEN doi IS NOT NULL THEN 'High' WHEN arxiv IS NOT NULL THEN 'Medium' ELSE 'Low' END"


def _identity(w: DataFrame) -> DataFrame:
    has = lambda ns: F.exists("ids", lambda x: x["ns"] == ns)
    return w.select("source_provider", "year", records.identity_level(has("doi"), has("arxiv")).alias("identity"))


@registered(with_works(f"SELECT source_provider, year, identity, CAST(GROUPING(source_provider, year, identity) AS BIGINT) AS level, CAST(count(*) AS BIGINT) AS n FROM (SELECT source_provider, year, {_IDENTITY_SQL} AS identity FROM works) GROUP BY CUBE (source_provider, year, identity)"))
def corpus_cube(spark: SparkSession, d: str) -> DataFrame:
    return summaries.cube(_identity(works(spark, d)), "source_provider", "year", "identity")


@registered(with_works(f"SELECT source_provider, identity, CAST(GROUPING(source_provider, identity) AS BIGINT) AS level, CAST(count(*) AS BIGINT) AS n FROM (SELECT source_provider, {_IDENTITY_SQL} AS identity FROM works) GROUP BY ROLLUP (source_provider, identity)"))
def corpus_rollup(spark: SparkSession, d: str) -> DataFrame:
    return summaries.rollup(_identity(works(spark, d)), "source_provider", "identity")


@registered(with_works("SELECT source_provider, CAST(count(DISTINCT norm_title) AS BIGINT) AS titles, true AS within FROM works GROUP BY 1 UNION ALL SELECT NULL, CAST(count(DISTINCT norm_title) AS BIGINT), true FROM works"))
def title_sketches(spark: SparkSession, d: str) -> DataFrame:
    """Distinct titles by source and of all, and whether the estimate of the (merged) sketches is within five standard errors."""
    w = works(spark, d).select("source_provider", "norm_title")
    tables = summaries.sketches(w, "source_provider", F.col("norm_title"))
    guess = summaries.merged(tables, "source_provider").unionByName(summaries.merged(tables).withColumn("source_provider", F.lit(None).cast("string")))
    exact = w.groupBy("source_provider").agg(F.count_distinct("norm_title").alias("titles")).unionByName(w.agg(F.count_distinct("norm_title").alias("titles")).withColumn("source_provider", F.lit(None).cast("string")))
    both = exact.withColumnRenamed("source_provider", "s").join(guess, F.col("s").eqNullSafe(F.col("source_provider")))
    return both.select("source_provider", "titles", (F.abs(F.col("distinct_values") - F.col("titles")) <= 5 * 1.04 / 2 ** (summaries.SKETCH_K / 2) * F.col("titles") + 1).alias("within"))


# ---------------------------------------------------------------- payloads

@registered(
    """WITH c AS (SELECT conv_id, list({'turn': turn, 'role': role, 'text': text} ORDER BY turn, role, text) AS m FROM conversations GROUP BY 1)
SELECT conv_id, m[1].role AS role, trim(coalesce(m[2].text, '')) AS answer, CAST(m[1].turn AS BIGINT) AS turn, CAST(conv_id AS BIGINT) AS number, CAST(NULL AS BIGINT) AS no_number, CAST(len(m) AS BIGINT) AS messages, coalesce(m[3].role, m[1].role) AS first_known FROM c"""
)
def payload_paths(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as nested JSON payloads, read back by dotted paths."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))
    payload = F.to_json(F.struct(F.struct(F.concat(F.lit(" "), F.col("conv_id").cast("string")).alias("id")).alias("head"), "messages"))
    v = c.select("conv_id", paths.parsed(payload).alias("v"))
    data = F.col("v")
    return v.select(
        "conv_id",
        paths.get_string(data, "messages.0.role").alias("role"),
        paths.get_string(data, "messages.1.text").alias("answer"),
        paths.get_int(data, "messages.0.turn").alias("turn"),
        paths.get_int(data, "head.id").alias("number"),
        paths.get_int(data, "messages.0.role").alias("no_number"),
        F.size(paths.get_list(data, "messages")).cast("long").alias("messages"),
        paths.get_first(data, "title", "messages.2.role", "messages.0.role").alias("first_known"),
    )


@registered("SELECT event_type, key, CAST(count(*) AS BIGINT) AS n, CAST(sum(TRY_CAST(json_extract_string(props, '$.' || key) AS BIGINT)) AS BIGINT) AS total FROM (SELECT event_type, props, unnest(json_keys(props)) AS key FROM events) GROUP BY 1, 2")
def metadata_maps(spark: SparkSession, d: str) -> DataFrame:
    """Which members the events' metadata have, by type of event."""
    e = table(spark, d, "events").select("event_type", F.explode(paths.get_map(F.col("props"))).alias("key", "value"))
    return e.groupBy("event_type", "key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr("try_cast(value as bigint)")).alias("total"))


@registered(
    with_works(
        "SELECT seq, title, year, cited_by_count, source_provider, is_retracted, CAST(1 + (doi IS NOT NULL)::INT + (arxiv IS NOT NULL)::INT AS BIGINT) AS n_ids, coalesce(doi, arxiv) AS name, CASE WHEN seq % 2 = 0 THEN 'journal' WHEN seq % 3 = 0 THEN 'conference' END AS venue_type, lang AS family FROM works"
    )
)
def record_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Records through the form in which a cache keeps them, and back: a venue without a type is a journal."""
    w = works(spark, d)
    kind = F.when(F.col("seq") % 2 == 0, F.lit(None)).otherwise(F.lit("conference")).cast("string")
    venue = F.when((F.col("seq") % 2 == 0) | (F.col("seq") % 3 == 0), F.struct(F.concat(F.lit("Venue of "), F.col("source_provider")).alias("name"), F.lit(None).cast("string").alias("issn"), kind.alias("type")))
    authors = F.array(F.struct(F.col("lang").alias("family"), F.lit(None).cast("string").alias("given"), F.lit(None).cast("string").alias("orcid")))
    back = records_io.from_payload(records_io.to_payload(w.withColumn("venue", venue).withColumn("authors", authors), "seq"), "seq")
    return back.select("seq", "title", "year", "cited_by_count", "source_provider", "is_retracted", F.size("ids").cast("long").alias("n_ids"), idf.primary(F.col("ids"))["value"].alias("name"), F.col("venue.type").alias("venue_type"), F.get("authors", F.lit(0))["family"].alias("family"))
