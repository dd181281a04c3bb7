"""The registered queries over the bibliographic projection, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import identifiers as idf
from citeloom.functions import records, text
from citeloom.operators import dedup, graph, review
from citeloom.operators.corpus import Corpus, identity_groups
from citeloom.plans import registry
from citeloom.plans.registry import Query, registered, with_works
from citeloom.sources.projection import AUTHORS_SQL, CITATIONS_SQL, DECISIONS_SQL, authored, citations, decisions, norm_sql, persons_of, table, work_authors, works
from citeloom.sources.scratch import stash

IDS_SQL = """wids AS (
  SELECT seq, 'doi' AS ns, doi AS value FROM works WHERE doi IS NOT NULL UNION ALL SELECT seq, 'arxiv', arxiv FROM works WHERE arxiv IS NOT NULL
  UNION ALL SELECT seq, 'internal', CAST(seq AS VARCHAR) FROM works
)"""
DOI_PAIRS = "SELECT f.primary_seq, w.seq AS secondary_seq, 'doi_match' AS reason, 1.0::DOUBLE AS confidence, 0 AS policy_rank, 'doi' AS policy FROM works w JOIN (SELECT doi, min(seq) AS primary_seq FROM works WHERE doi IS NOT NULL GROUP BY doi) f ON w.doi = f.doi WHERE w.seq <> f.primary_seq"
ARXIV_PAIRS = "SELECT f.primary_seq, w.seq AS secondary_seq, 'arxiv_match' AS reason, 1.0::DOUBLE AS confidence, 1 AS policy_rank, 'arxiv' AS policy FROM works w JOIN (SELECT arxiv, min(seq) AS primary_seq FROM works WHERE arxiv IS NOT NULL GROUP BY arxiv) f ON w.arxiv = f.arxiv WHERE w.seq <> f.primary_seq"
FUZZY_SQL = """near AS (
  SELECT seq, norm_title AS a, year AS ya, lead(seq) OVER w AS next_seq, lead(norm_title) OVER w AS b, lead(year) OVER w AS yb FROM works WHERE norm_title <> '' WINDOW w AS (ORDER BY norm_title, seq)
), fuzzy AS (
  SELECT seq AS primary_seq, next_seq AS secondary_seq, CASE WHEN a = b THEN 100 ELSE CAST(round((1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b))) * 100) AS INTEGER) END AS ratio
  FROM near WHERE b IS NOT NULL AND abs(ya - yb) <= 1
)"""
FUZZY_PAIRS = "SELECT primary_seq, secondary_seq, 'title_fuzzy' AS reason, round(ratio / 100.0::DOUBLE, 2) AS confidence, 5 AS policy_rank, 'title_fuzzy' AS policy FROM fuzzy WHERE ratio >= 95"
PAIRS_SQL = f"pairs AS ({DOI_PAIRS} UNION ALL {ARXIV_PAIRS} UNION ALL {FUZZY_PAIRS})"
CLUSTERS_SQL = """links AS (SELECT primary_seq AS x, secondary_seq AS y FROM pairs UNION SELECT secondary_seq, primary_seq FROM pairs),
reach AS (SELECT seq AS x, seq AS root FROM works UNION SELECT links.y, reach.root FROM reach JOIN links ON links.x = reach.x),
members AS (SELECT x AS seq, min(root) AS cluster_id FROM reach GROUP BY x)"""
SCORE_SQL = """(CASE WHEN doi IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN abstract IS NOT NULL THEN 2 ELSE 0 END + 1 + CASE WHEN cited_by_count IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN is_retracted THEN 0 ELSE 1 END)"""
PRIORITY_SQL = "CASE source_provider WHEN 'openalex' THEN 5 WHEN 'crossref' THEN 4 WHEN 'semantic_scholar' THEN 3 WHEN 'arxiv' THEN 2 WHEN 'pubmed' THEN 2 WHEN 'ieee' THEN 1 WHEN 'doaj' THEN 1 ELSE 0 END"
ELECT_SQL = f"""elected AS (
  SELECT m.cluster_id, w.*, row_number() OVER (PARTITION BY m.cluster_id ORDER BY {SCORE_SQL} + {PRIORITY_SQL} DESC, (w.doi IS NULL), w.seq) AS place FROM members m JOIN works w ON m.seq = w.seq
)"""
FULL_CLUSTERS = [FUZZY_SQL, PAIRS_SQL, CLUSTERS_SQL]


# ---------------------------------------------------------------- scalars

@registered(with_works("SELECT seq, norm_title FROM works"))
def norm_title(spark: SparkSession, d: str) -> DataFrame:
    return works(spark, d).select("seq", "norm_title")


@registered(with_works("SELECT seq, doi AS doi_value FROM works WHERE doi IS NOT NULL"))
def doi_normalize(spark: SparkSession, d: str) -> DataFrame:
    return works(spark, d).where("raw_doi is not null").select("seq", idf.normalize_doi(F.col("raw_doi")).alias("doi_value"))


@registered(with_works("SELECT seq, CASE WHEN doi IS NOT NULL THEN 'doi:' || doi WHEN arxiv IS NOT NULL THEN 'arxiv:' || arxiv END AS primary_key, CASE WHEN doi IS NOT NULL THEN 'doi:' || doi || '|' ELSE '' END || CASE WHEN arxiv IS NOT NULL THEN 'arxiv:' || arxiv || '|' ELSE '' END || 'internal:' || seq AS all_ids FROM works"))
def primary_id(spark: SparkSession, d: str) -> DataFrame:
    p = idf.primary(F.col("ids"))
    return works(spark, d).select("seq", F.when(p.isNotNull(), idf.id_string(p)).alias("primary_key"), idf.ids_string(F.col("ids")).alias("all_ids"))


@registered(with_works(f"SELECT seq, CAST({SCORE_SQL} AS INTEGER) AS completeness, CAST({SCORE_SQL} + {PRIORITY_SQL} AS INTEGER) AS score FROM works"))
def completeness_score(spark: SparkSession, d: str) -> DataFrame:
    w = works(spark, d)
    return w.select("seq", (dedup.score(w) - records.priority(F.col("source_provider"))).alias("completeness"), dedup.score(w).alias("score"))


@registered(with_works("SELECT seq, CASE WHEN doi IS NOT NULL THEN 'High' WHEN arxiv IS NOT NULL THEN 'Medium' ELSE 'Low' END AS identity, abstract IS NOT NULL AS has_abstract, source_provider = 'arxiv' AS is_preprint FROM works"))
def identity_confidence(spark: SparkSession, d: str) -> DataFrame:
    has = lambda ns: F.exists("ids", lambda x: x["ns"] == ns)
    return works(spark, d).select("seq", records.identity_level(has("doi"), has("arxiv")).alias("identity"), F.col("abstract").isNotNull().alias("has_abstract"), records.is_preprint(F.col("source_provider"), F.lit(None).cast("string")).alias("is_preprint"))


@registered(with_works("SELECT seq, sha256(concat_ws('|', title, CAST(year AS VARCHAR), '', lang, '100', '0', CASE WHEN source_provider = 'arxiv' THEN 'arxiv' ELSE 'arxiv,' || source_provider END)) AS key FROM works"))
def cache_key(spark: SparkSession, d: str) -> DataFrame:
    """The key of the search that asks for a work's whole title in its source and in arXiv."""
    key = text.cache_key(F.col("title"), F.col("year"), F.lit(None), F.col("lang"), F.lit(100), F.lit(0), F.array_distinct(F.array("source_provider", F.lit("arxiv"))))
    return works(spark, d).select("seq", key.alias("key"))


@registered(with_works(r"SELECT seq, regexp_replace(title, '([+\-&|!(){}\[\]^\"~*?:/\\])', '\\\1', 'g') AS lucene, CASE WHEN length(title) > 48 THEN substr(title, 1, 48) || '…' ELSE title END AS short FROM works"))
def query_strings(spark: SparkSession, d: str) -> DataFrame:
    return works(spark, d).select("seq", text.lucene_escape(F.col("title")).alias("lucene"), text.ellipsis(F.col("title")).alias("short"))


@registered(f"SELECT page_id, {norm_sql(chr(114) + 'egexp_extract(html, ' + chr(39) + '<title>([^<]*)</title>' + chr(39) + ', 1)')} AS norm_title FROM pages")
def html_title_clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.normalize_title(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("norm_title"))


@registered("SELECT s_suppkey, list_last(string_split_regex(trim(s_name), '\\s+')) AS family, nullif(array_to_string(list_slice(string_split_regex(trim(s_name), '\\s+'), 1, -2), ' '), '') AS given, trim(regexp_replace(regexp_replace(strip_accents(lower(s_name)), '[^a-z\\s]', '', 'g'), '\\s+', ' ', 'g')) AS normalized FROM supplier")
def author_names(spark: SparkSession, d: str) -> DataFrame:
    p = text.parse_author(F.col("s_name"))
    return table(spark, d, "supplier").select("s_suppkey", p["family"].alias("family"), p["given"].alias("given"), text.normalize_author(F.col("s_name")).alias("normalized"))


@registered("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def json_extract_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.expr("try_cast(get_json_object(props, '$.k') as bigint)").alias("k"), text.atom_timestamp(F.col("ts")).alias("at"))


# ---------------------------------------------------------------- filters, order, sets

@registered(with_works("SELECT seq, year FROM works WHERE year BETWEEN 2010 AND 2015"))
def filter_year_range(spark: SparkSession, d: str) -> DataFrame:
    return Corpus(works(spark, d)).in_years(2010, 2015).df.select("seq", "year")


@registered(with_works("SELECT seq FROM works WHERE NOT is_retracted"))
def without_retracted(spark: SparkSession, d: str) -> DataFrame:
    return Corpus(works(spark, d)).without_retracted().df.select("seq")


@registered(with_works("SELECT seq, source_provider, year FROM works WHERE source_provider IN ('openalex', 'crossref') AND year BETWEEN 2005 AND 2020 AND abstract IS NOT NULL AND NOT is_retracted"))
def corpus_browser(spark: SparkSession, d: str) -> DataFrame:
    c = Corpus(works(spark, d)).filter(F.col("source_provider").isin("openalex", "crossref") & F.col("abstract").isNotNull() & ~F.col("is_retracted"))
    return c.in_years(2005, 2020).df.select("seq", "source_provider", "year")


@registered(with_works("SELECT seq, year FROM works ORDER BY coalesce(year, 0) DESC, seq"))
def sort_year(spark: SparkSession, d: str) -> DataFrame:
    return Corpus(works(spark, d)).sort_by_year().select("seq", "year")


@registered(with_works("SELECT seq, CASE WHEN length(title) > 48 THEN substr(title, 1, 48) || '…' ELSE title END AS short, cited_by_count FROM works ORDER BY coalesce(cited_by_count, 0) DESC, seq LIMIT 15"))
def topk_cited(spark: SparkSession, d: str) -> DataFrame:
    return Corpus(works(spark, d)).top_cited(15).select("seq", text.ellipsis(F.col("title")).alias("short"), "cited_by_count")


@registered(with_works("SELECT seq FROM works ORDER BY seq LIMIT 25 OFFSET 50"))
def page_offset_limit(spark: SparkSession, d: str) -> DataFrame:
    return Corpus(works(spark, d)).page(50, 25).select("seq")


@registered(with_works("SELECT source_provider, seq FROM works QUALIFY row_number() OVER (PARTITION BY source_provider ORDER BY seq) <= 20"))
def per_source_limit(spark: SparkSession, d: str) -> DataFrame:
    return Corpus(works(spark, d)).per_source(20).df.select("source_provider", "seq")


@registered(with_works("SELECT source_provider, seq, CAST(list_position(['arxiv', 'crossref', 'doaj', 'ieee', 'openalex', 'pubmed', 'semantic_scholar'], source_provider) AS INTEGER) AS source_rank FROM works"))
def union_sources(spark: SparkSession, d: str) -> DataFrame:
    from citeloom.operators.corpus import union_sources as union

    w = stash(works(spark, d).select("source_provider", "seq"), "by-source")
    return union([w.where(F.col("source_provider") == s) for s in records.SOURCES]).withColumn("source_rank", records.source_rank(F.col("source_provider")))


@registered(with_works("SELECT seq FROM works WHERE seq NOT IN (SELECT a.seq FROM wids a JOIN wids b ON a.ns = b.ns AND a.value = b.value JOIN works w ON b.seq = w.seq AND w.is_retracted)", IDS_SQL))
def subtract_corpus(spark: SparkSession, d: str) -> DataFrame:
    c = Corpus(works(spark, d))
    return c.subtract(c.retracted()).df.select("seq")


@registered(with_works("SELECT DISTINCT a.seq FROM wids a JOIN wids b ON a.ns = b.ns AND a.value = b.value JOIN works w ON b.seq = w.seq AND w.source_provider = 'openalex'", IDS_SQL))
def id_overlap_semijoin(spark: SparkSession, d: str) -> DataFrame:
    c = Corpus(works(spark, d))
    return c.contains(c.filter(F.col("source_provider") == "openalex")).df.select("seq")


@registered(with_works("SELECT seq, min(root) AS group_id FROM reach GROUP BY seq", IDS_SQL, "links AS (SELECT DISTINCT a.seq AS x, b.seq AS y FROM wids a JOIN wids b ON a.ns = b.ns AND a.value = b.value AND a.seq <> b.seq), reach AS (SELECT seq, seq AS root FROM works UNION SELECT links.y, reach.root FROM reach JOIN links ON links.x = reach.seq)", recursive=True))
def merge_groups(spark: SparkSession, d: str) -> DataFrame:
    return identity_groups(works(spark, d)).select("seq", F.col("group").alias("group_id"))


@registered(f"WITH {AUTHORS_SQL}, tagged AS (SELECT a.*, o.o_orderstatus = 'F' AS mine FROM authors a JOIN orders o ON a.seq = o.o_orderkey) SELECT DISTINCT seq, position, name FROM tagged WHERE mine AND normalized IN (SELECT normalized FROM tagged WHERE NOT mine)")
def author_intersect(spark: SparkSession, d: str) -> DataFrame:
    """All authors of finished orders against all authors of the others; persons are compared, and their lines joined with them."""
    from citeloom.operators.corpus import shared_authors

    people = persons_of(spark, d)
    lines = authored(spark, d, "l_suppkey")
    theirs = people.join(lines.where("not mine").select("l_suppkey").distinct(), "l_suppkey", "left_semi")
    shared = shared_authors(people, theirs).select("l_suppkey", "name")
    return lines.where("mine").join(shared, "l_suppkey").select("seq", "position", "name").distinct()


@registered(f"WITH {AUTHORS_SQL} SELECT seq, string_agg(family, '|' ORDER BY position, name) AS families, CAST(count(*) AS BIGINT) AS n FROM authors GROUP BY seq")
def author_position(spark: SparkSession, d: str) -> DataFrame:
    lists = work_authors(spark, d).groupBy("seq").agg(F.sort_array(F.collect_list(F.struct("position", "name", "family"))).alias("a"))
    return lists.select("seq", F.array_join(F.transform("a", lambda x: x["family"]), "|").alias("families"), F.size("a").cast("long").alias("n"))


# ---------------------------------------------------------------- entity resolution

@registered(with_works(f"SELECT primary_seq, secondary_seq, reason, confidence FROM ({DOI_PAIRS})"))
def exact_doi_pairs(spark: SparkSession, d: str) -> DataFrame:
    return dedup.namespace_policy("doi")(works(spark, d))


@registered(with_works(f"SELECT primary_seq, secondary_seq, reason, confidence FROM ({ARXIV_PAIRS})"))
def namespace_pairs(spark: SparkSession, d: str) -> DataFrame:
    return dedup.namespace_policy("arxiv")(works(spark, d))


@registered(with_works("SELECT f.primary_seq, k.seq AS secondary_seq, 'fingerprint' AS reason, 0.9::DOUBLE AS confidence FROM keyed k JOIN (SELECT key, min(seq) AS primary_seq FROM keyed GROUP BY key) f ON k.key = f.key WHERE k.seq <> f.primary_seq", "keyed AS (SELECT seq, md5(substr(norm_title, 1, 50) || '::' || year) AS key FROM works)"))
def fingerprint_pairs(spark: SparkSession, d: str) -> DataFrame:
    return dedup.fingerprint_policy(works(spark, d))


@registered(with_works(f"SELECT primary_seq, secondary_seq, reason, confidence FROM ({FUZZY_PAIRS})", FUZZY_SQL))
def title_fuzzy_pairs(spark: SparkSession, d: str) -> DataFrame:
    return dedup.title_fuzzy_policy()(works(spark, d))


@registered(with_works("SELECT policy, CAST(count(*) AS BIGINT) AS pairs FROM (SELECT least(primary_seq, secondary_seq) AS a, greatest(primary_seq, secondary_seq) AS b, arg_min(policy, policy_rank) AS policy FROM pairs GROUP BY 1, 2) GROUP BY policy", FUZZY_SQL, PAIRS_SQL))
def policy_stats(spark: SparkSession, d: str) -> DataFrame:
    return dedup.policy_stats(dedup.detect(works(spark, d), dedup.POLICIES))


@registered(with_works("SELECT seq, cluster_id FROM members", *FULL_CLUSTERS, recursive=True))
def dedup_clusters(spark: SparkSession, d: str) -> DataFrame:
    return dedup.deduplicate(works(spark, d))


@registered(with_works("SELECT CAST(count(*) AS BIGINT) AS input_count, CAST(count(DISTINCT cluster_id) AS BIGINT) AS unique_count, CAST(count(*) - count(DISTINCT cluster_id) AS BIGINT) AS duplicates_removed FROM members", *FULL_CLUSTERS, recursive=True))
def dedup_summary(spark: SparkSession, d: str) -> DataFrame:
    w = works(spark, d)
    return dedup.summary(w, dedup.deduplicate(w))


@registered(with_works(f"SELECT cluster_id, max(CASE WHEN place = 1 THEN seq END) AS representative, CAST(count(*) AS BIGINT) AS cluster_size, CAST(max({SCORE_SQL} + {PRIORITY_SQL}) AS INTEGER) AS score FROM elected GROUP BY cluster_id", *FULL_CLUSTERS, ELECT_SQL, recursive=True))
def elect_representative(spark: SparkSession, d: str) -> DataFrame:
    w = works(spark, d)
    return dedup.elect(w, dedup.deduplicate(w))


FUSED_SQL = """SELECT cluster_id, arg_min(title, o) AS title, arg_min(source_provider, o) AS source_provider, arg_min(is_retracted, o) AS is_retracted, arg_min(year, o) AS year,
  arg_min(abstract, o) FILTER (WHERE abstract IS NOT NULL) AS abstract, max(cited_by_count) AS cited_by_count, CAST(count(DISTINCT doi) + count(DISTINCT arxiv) + count(*) AS BIGINT) AS n_ids
FROM (SELECT *, CASE WHEN place = 1 THEN -1 ELSE seq END AS o FROM elected) GROUP BY cluster_id"""


@registered(with_works(FUSED_SQL, *FULL_CLUSTERS, ELECT_SQL, recursive=True))
def fuse_records(spark: SparkSession, d: str) -> DataFrame:
    w = works(spark, d)
    fused = dedup.fuse_clusters(w, dedup.deduplicate(w))
    return fused.select("cluster_id", "title", "source_provider", "is_retracted", "year", "abstract", "cited_by_count", F.size("ids").cast("long").alias("n_ids"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return Corpus(fuse_records(spark, d).withColumnRenamed("cluster_id", "seq")).top_cited(15).select("seq", text.ellipsis(F.col("title")).alias("title"), "year", "source_provider", "cited_by_count", "n_ids")


# ---------------------------------------------------------------- aggregates

@registered(with_works("SELECT m.cluster_id, w.source_provider, CAST(count(*) AS BIGINT) AS n FROM members m JOIN works w ON m.seq = w.seq GROUP BY 1, 2", *FULL_CLUSTERS, recursive=True))
def provider_counts(spark: SparkSession, d: str) -> DataFrame:
    w = works(spark, d)
    return dedup.deduplicate(w).join(w.select("seq", "source_provider"), "seq").groupBy("cluster_id", "source_provider").agg(F.count(F.lit(1)).alias("n"))


@registered(with_works("SELECT m.cluster_id, CAST(count(DISTINCT w.source_provider) AS BIGINT) AS sources FROM members m JOIN works w ON m.seq = w.seq GROUP BY 1", *FULL_CLUSTERS, recursive=True))
def source_badges(spark: SparkSession, d: str) -> DataFrame:
    w = works(spark, d)
    return review.source_badges(dedup.deduplicate(w), w)


@registered(with_works("SELECT source_provider, CAST(count(*) AS BIGINT) AS raw, CAST(count(DISTINCT doi) AS BIGINT) AS dois, round(count(DISTINCT doi) * 100.0::DOUBLE / count(*), 6) AS share FROM works GROUP BY 1"))
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    doi = idf.find_namespace(F.col("ids"), "doi")
    stats = works(spark, d).select("source_provider", doi.alias("doi")).groupBy("source_provider").agg(F.count(F.lit(1)).alias("raw"), F.count_distinct("doi").alias("dois"))
    return stats.withColumn("share", F.round(F.col("dois") * 100.0 / F.col("raw"), 6))


@registered(with_works("SELECT year, CAST(count(*) AS BIGINT) AS n FROM works GROUP BY year"))
def year_distribution(spark: SparkSession, d: str) -> DataFrame:
    return Corpus(works(spark, d)).year_counts()


@registered(f"WITH {DECISIONS_SQL} SELECT project, stage, work, decision, decided_by, decision_id FROM decisions QUALIFY row_number() OVER (PARTITION BY project, stage, work ORDER BY decided_at DESC, decision_id DESC) = 1")
def latest_decision(spark: SparkSession, d: str) -> DataFrame:
    return review.latest_decisions(decisions(spark, d)).select("project", "stage", "work", "decision", "decided_by", "decision_id")


LATEST_SQL = f"{DECISIONS_SQL}, latest AS (SELECT * FROM decisions QUALIFY row_number() OVER (PARTITION BY project, stage, work ORDER BY decided_at DESC, decision_id DESC) = 1)"


@registered(
    f"""WITH {LATEST_SQL}, c AS (
  SELECT project, stage, CAST(count(*) FILTER (WHERE decision = 'include') AS BIGINT) AS "include", CAST(count(*) FILTER (WHERE decision = 'exclude') AS BIGINT) AS "exclude",
    CAST(count(*) FILTER (WHERE decision = 'maybe') AS BIGINT) AS maybe, CAST(count(*) FILTER (WHERE decision = 'conflict') AS BIGINT) AS "conflict", CAST(count(*) AS BIGINT) AS screened FROM latest GROUP BY 1, 2
), t AS (SELECT project, CAST(count(DISTINCT work) AS BIGINT) AS total FROM decisions GROUP BY 1)
SELECT c.*, t.total, t.total - screened AS remaining, CASE WHEN total - "conflict" > 0 THEN round((screened - "conflict") * 100.0::DOUBLE / (total - "conflict"), 2) ELSE 0.0 END AS percent FROM c JOIN t ON c.project = t.project"""
)
def screening_progress(spark: SparkSession, d: str) -> DataFrame:
    log = decisions(spark, d)
    total = log.groupBy("project").agg(F.count_distinct("work").alias("total"))
    return review.screening_progress(review.latest_decisions(log), total)


@registered(
    f"""WITH {DECISIONS_SQL}, e AS (SELECT project, work, decision, count(*) AS n FROM decisions GROUP BY ALL), p AS (SELECT project, work, CAST(sum(n) AS BIGINT) AS voters, max(n) AS top, count(*) AS kinds FROM e GROUP BY ALL)
SELECT project, work, voters, CASE WHEN voters = 1 THEN 'none' WHEN kinds = 1 THEN 'agree' WHEN 2 * top > voters THEN 'soft' ELSE 'hard' END AS route FROM p"""
)
def conflict_routing(spark: SparkSession, d: str) -> DataFrame:
    return review.conflict_routing(decisions(spark, d))


@registered(
    """WITH s AS (SELECT user_id AS run, ['arxiv', 'crossref', 'doaj', 'ieee', 'openalex', 'pubmed', 'semantic_scholar'][1 + event_id % 7] AS source, NOT (event_id % 11 = 0) AS ok FROM events)
SELECT run, CAST(count(*) FILTER (WHERE NOT ok) AS BIGINT) AS failures, count(*) FILTER (WHERE NOT ok) >= 1 AS soft, count(*) FILTER (WHERE NOT ok) >= 3 OR coalesce(bool_or(NOT ok AND source IN ('openalex', 'crossref')), false) AS hard FROM s GROUP BY run"""
)
def provider_failure_gate(spark: SparkSession, d: str) -> DataFrame:
    source = F.get(F.array(*[F.lit(s) for s in records.SOURCES]), (F.col("event_id") % 7).cast("int"))
    stats = table(spark, d, "events").select(F.col("user_id").alias("run"), source.alias("source"), (F.col("event_id") % 11 != 0).alias("ok"))
    return review.failure_gates(stats, ["openalex", "crossref"])


@registered(
    with_works(
        """SELECT 'identified:' || source_provider AS step, CAST(count(*) AS BIGINT) AS n FROM works GROUP BY 1 UNION ALL SELECT 'duplicates_removed', CAST(count(*) - count(DISTINCT cluster_id) AS BIGINT) FROM members
UNION ALL SELECT 'screened', CAST(count(*) AS BIGINT) FROM latest WHERE stage = 'title_abstract' UNION ALL SELECT 'excluded:' || stage, CAST(count(*) AS BIGINT) FROM latest WHERE decision = 'exclude' GROUP BY 1
UNION ALL SELECT 'included', CAST(count(*) AS BIGINT) FROM latest WHERE decision = 'include' AND stage = 'final'""",
        *FULL_CLUSTERS, LATEST_SQL, recursive=True,
    )
)
def prisma_counts(spark: SparkSession, d: str) -> DataFrame:
    w = works(spark, d)
    return review.flow_counts(w, dedup.deduplicate(w), review.latest_decisions(decisions(spark, d)))


@registered(
    """WITH a AS (SELECT event_id % 997 AS work, ['arxiv', 'crossref', 'doaj', 'ieee', 'openalex', 'pubmed', 'semantic_scholar'][1 + user_id % 7] AS source, event_id % 3 = 0 AS ok, ts, event_id FROM events)
SELECT work, arg_min(source, (ts, event_id)) FILTER (WHERE ok) AS source, CAST(count(*) AS BIGINT) AS attempts FROM a GROUP BY work"""
)
def full_text_chain(spark: SparkSession, d: str) -> DataFrame:
    source = F.get(F.array(*[F.lit(s) for s in records.SOURCES]), (F.col("user_id") % 7).cast("int"))
    attempts = table(spark, d, "events").select((F.col("event_id") % 997).alias("work"), source.alias("source"), (F.col("event_id") % 3 == 0).alias("ok"), F.col("ts").alias("attempted_at"), F.col("event_id").alias("attempt_id"))
    return review.first_success(attempts)


# ---------------------------------------------------------------- graph

NODES_SQL = "nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges)"
DEGREES_SQL = "deg AS (SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (SELECT src AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY node)"


@registered(f"WITH {CITATIONS_SQL}, {DEGREES_SQL} SELECT node, in_degree, out_degree, out_degree::DOUBLE / (in_degree + out_degree + 1) AS hub, in_degree::DOUBLE / (in_degree + out_degree + 1) AS authority FROM deg")
def in_out_degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(citations(spark, d))


@registered(f"WITH {CITATIONS_SQL} SELECT x.dst AS a, y.dst AS b, CAST(count(*) AS BIGINT) AS weight FROM edges x JOIN edges y ON x.src = y.src AND x.dst < y.dst GROUP BY 1, 2")
def co_citation(spark: SparkSession, d: str) -> DataFrame:
    return graph.co_citation(citations(spark, d))


@registered(f"WITH {CITATIONS_SQL} SELECT x.src AS a, y.src AS b, CAST(count(*) AS BIGINT) AS weight FROM edges x JOIN edges y ON x.dst = y.dst AND x.src < y.src GROUP BY 1, 2")
def bib_coupling(spark: SparkSession, d: str) -> DataFrame:
    return graph.coupling(citations(spark, d))


def _pagerank_sql(rounds: int) -> str:
    steps = ["r0 AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS rank FROM nodes)"]
    for k in range(rounds):
        steps.append(
            f"r{k + 1} AS (SELECT n.node, 0.15::DOUBLE / (SELECT count(*) FROM nodes) + 0.85::DOUBLE * (coalesce(g.got, 0) + (SELECT coalesce(sum(rank), 0) FROM r{k} WHERE node NOT IN (SELECT src FROM edges)) / (SELECT count(*) FROM nodes)) AS rank "
            f"FROM nodes n LEFT JOIN (SELECT e.dst, sum(r.rank / o.n) AS got FROM edges e JOIN r{k} r ON e.src = r.node JOIN outs o ON o.src = e.src GROUP BY 1) g ON n.node = g.dst)"
        )
    return f"WITH {CITATIONS_SQL}, {NODES_SQL}, outs AS (SELECT src, count(*) AS n FROM edges GROUP BY 1), {', '.join(steps)} SELECT node, round(rank, 9) AS rank FROM r{rounds}"


@registered(_pagerank_sql(10))
def pagerank10(spark: SparkSession, d: str) -> DataFrame:
    return graph.pagerank(citations(spark, d), rounds=10, tolerance=0.0).select("node", F.round("rank", 9).alias("rank"))


def _kcore_sql(k: int, rounds: int) -> str:
    steps = ["e0 AS (SELECT src, dst FROM edges), k0 AS (SELECT node FROM nodes)"]
    for i in range(rounds):
        steps.append(f"d{i} AS (SELECT n.node, count(e.src) AS degree FROM k{i} n LEFT JOIN e{i} e ON e.dst = n.node GROUP BY 1), k{i + 1} AS (SELECT node FROM d{i} WHERE degree >= {k}), e{i + 1} AS (SELECT * FROM e{i} WHERE src IN (SELECT node FROM k{i + 1}) AND dst IN (SELECT node FROM k{i + 1}))")
    return f"WITH {CITATIONS_SQL}, {NODES_SQL}, {', '.join(steps)} SELECT node, CAST(degree AS BIGINT) AS degree FROM d{rounds - 1} WHERE degree >= {k}"


@registered(_kcore_sql(20, 14))
def kcore(spark: SparkSession, d: str) -> DataFrame:
    return graph.k_core(citations(spark, d), 20)


@registered(
    f"""WITH RECURSIVE {CITATIONS_SQL}, {DEGREES_SQL}, b AS (
  SELECT node, 0 AS depth FROM deg WHERE out_degree = (SELECT max(out_degree) FROM deg) UNION SELECT e.dst, b.depth + 1 FROM b JOIN edges e ON e.src = b.node WHERE b.depth < 20
) SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM b GROUP BY node"""
)
def bfs_levels(spark: SparkSession, d: str) -> DataFrame:
    """From the works with the longest lists of references, to any depth."""
    edges = citations(spark, d)
    found = graph.degrees(edges)
    start = found.join(found.agg(F.max("out_degree").alias("out_degree")), "out_degree").select("node")
    return graph.bfs_levels(edges, start).select("node", "depth")


def _snowball_sql(depth: int, limit: int) -> str:
    steps = [f"{DEGREES_SQL}, k0 AS (SELECT node FROM deg WHERE in_degree = (SELECT min(in_degree) FROM deg)), n0 AS (SELECT node FROM k0)"]
    for i in range(1, depth + 1):
        steps.append(
            f"f{i} AS (SELECT node FROM (SELECT src AS node FROM edges WHERE dst IN (SELECT node FROM n{i - 1}) QUALIFY row_number() OVER (PARTITION BY dst ORDER BY src) <= {limit}) "
            f"UNION SELECT node FROM (SELECT dst AS node FROM edges WHERE src IN (SELECT node FROM n{i - 1}) QUALIFY row_number() OVER (PARTITION BY src ORDER BY dst) <= {limit})), "
            f"n{i} AS (SELECT node FROM f{i} WHERE node NOT IN (SELECT node FROM k{i - 1})), k{i} AS (SELECT node FROM k{i - 1} UNION SELECT node FROM n{i})"
        )
    return f"WITH {CITATIONS_SQL}, {', '.join(steps)} " + " UNION ALL ".join(f"SELECT node, {i} AS depth, node NOT IN (SELECT node FROM k{i - 1}) AS is_new FROM f{i}" for i in range(1, depth + 1))


@registered(_snowball_sql(5, 100))
def snowball_round(spark: SparkSession, d: str) -> DataFrame:
    """From the works that are cited least (by none, if there are such), with the operator's own limits and full depth."""
    edges = citations(spark, d)
    found = graph.degrees(edges)
    seeds = found.join(found.agg(F.min("in_degree").alias("in_degree")), "in_degree").select("node")
    return graph.snowball(edges, seeds, 5)


@registered(
    f"""WITH {CITATIONS_SQL}, {NODES_SQL}, u AS (SELECT DISTINCT least(src, dst) AS x, greatest(src, dst) AS y FROM edges), dg AS (SELECT node, count(*) AS d FROM (SELECT x AS node FROM u UNION ALL SELECT y FROM u) GROUP BY 1),
t AS (SELECT a.x AS p, a.y AS q, b.y AS r FROM u a JOIN u b ON a.y = b.x JOIN u c ON c.x = a.x AND c.y = b.y), tn AS (SELECT node, count(*) AS t FROM (SELECT p AS node FROM t UNION ALL SELECT q FROM t UNION ALL SELECT r FROM t) GROUP BY 1),
l AS (SELECT CASE WHEN d > 1 THEN 2.0::DOUBLE * coalesce(t, 0) / (d * (d - 1)) ELSE 0.0 END AS c FROM nodes LEFT JOIN dg ON nodes.node = dg.node LEFT JOIN tn ON nodes.node = tn.node)
SELECT CAST(count(*) AS BIGINT) AS node_count, CAST((SELECT count(*) FROM edges) AS BIGINT) AS edge_count, round((SELECT count(*) FROM edges)::DOUBLE / (count(*) * (count(*) - 1)), 9) AS density, round(avg(c), 9) AS avg_clustering FROM l"""
)
def density(spark: SparkSession, d: str) -> DataFrame:
    return graph.network_metrics(citations(spark, d)).select("node_count", "edge_count", F.round("density", 9).alias("density"), F.round("avg_clustering", 9).alias("avg_clustering"))


def queries() -> dict[str, Query]:
    return registry.queries()


def oracle_sql() -> dict[str, str]:
    return registry.oracle_sql()
