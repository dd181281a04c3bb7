"""Registered queries through sources and sinks: payloads of documents normalized back, federated answers, the store, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import identifiers as idf
from citeloom.plans import search
from citeloom.plans.catalog import NODES_SQL
from citeloom.plans.registry import registered, with_works
from citeloom.sources import export, payloads
from citeloom.sources.projection import CITATIONS_SQL, citations, table, works
from citeloom.sources.scratch import temporary_path
from citeloom.sources.store import Store

ORCID = "0000-0002-1825-0097"


def _answer(item: Column, source: str) -> Column:
    """An item as the only one of a source's answer, as JSON text."""
    inside = F.array(item)
    for name in reversed(payloads.ITEMS[source].split(".")):
        inside = F.struct(inside.alias(name))
    return F.to_json(inside)


def index_of_words(said: Column) -> Column:
    """{word: [places]}: words sorted with their places, then cut where the word changes, so that each place is read once."""
    ordered = F.sort_array(F.transform(said, lambda word, i: F.struct(word.alias("w"), i.alias("i"))))

    def cut(sorted_: Column) -> Column:
        last = F.size(sorted_) - 1
        starts = F.filter(F.sequence(F.lit(0), last), lambda k: (k == 0) | (F.get(sorted_, k)["w"] != F.get(sorted_, k - 1)["w"]))
        bounds = F.transform(F.array(starts), lambda b: F.zip_with(b, F.slice(b, F.lit(2), F.size(b)), lambda start, end: F.struct(start.alias("start"), (end - 1).alias("end"))))[0]
        return F.map_from_entries(F.transform(bounds, lambda r: F.struct(F.get(sorted_, r["start"])["w"], F.transform(F.sequence(r["start"], F.coalesce(r["end"], last)), lambda k: F.get(sorted_, k)["i"]))))

    # an array of one array: within the lambda it is a value, and not made again for each element
    return F.get(F.transform(F.array(ordered), cut), F.lit(0))


def openalex_items(w: DataFrame) -> Column:
    """Works as items of an OpenAlex answer; the abstract is an inverted index of the title's words."""
    index = index_of_words(F.split("title", " "))
    name = F.concat(F.lit("https://openalex.org/W"), F.col("seq").cast("string"))
    author = F.struct(F.struct(F.concat(F.lit("Ann van "), F.col("lang")).alias("display_name"), F.lit(f"https://orcid.org/{ORCID}").alias("orcid")).alias("author"))
    place = F.struct(F.struct(F.concat(F.lit("Letters of "), F.col("source_provider")).alias("display_name"), F.lit("1234-5678").alias("issn_l"), F.lit("journal").alias("type")).alias("source"))
    return F.struct(
        name.alias("id"), F.struct(name.alias("openalex"), F.col("raw_doi").alias("doi")).alias("ids"), F.col("title").alias("display_name"), F.col("year").alias("publication_year"),
        "cited_by_count", "is_retracted", place.alias("primary_location"), F.array(author).alias("authorships"), index.alias("abstract_inverted_index"),
    )


def crossref_items(w: DataFrame) -> Column:
    kind = F.when(F.col("seq") % 2 == 0, "journal-article").otherwise("proceedings-article")
    date = F.struct(F.array(F.array(F.col("year"), F.lit(1))).alias("date-parts"))
    return F.struct(
        F.col("raw_doi").alias("DOI"), F.array("title").alias("title"), F.array(F.struct(F.lit("Ann").alias("given"), F.col("lang").alias("family"), F.lit(ORCID).alias("ORCID"))).alias("author"),
        F.when(F.col("seq") % 3 != 0, date).alias("published"), date.alias("published-print"), F.array(F.lit(" Letters ")).alias("container-title"), kind.alias("type"), F.col("cited_by_count").alias("is-referenced-by-count"),
    )


def semantic_scholar_items(w: DataFrame) -> Column:
    ids = F.struct(F.col("raw_doi").alias("DOI"), F.regexp_replace("raw_arxiv", "^arXiv:", "").alias("ArXiv"))
    return F.struct(F.concat(F.lit("P"), F.col("seq").cast("string")).alias("paperId"), ids.alias("externalIds"), "title", "abstract", "year", F.lit("").alias("venue"), F.array(F.struct(F.concat(F.lit("Ann "), F.col("lang")).alias("name"))).alias("authors"), F.col("cited_by_count").alias("citationCount"))


_ITEMS = {"openalex": openalex_items, "crossref": crossref_items, "semantic_scholar": semantic_scholar_items}


def _normalized(spark: SparkSession, d: str, source: str, of: str | None = None) -> DataFrame:
    w = works(spark, d) if of is None else works(spark, d).where(of)
    return payloads.normalize(payloads.items_of(w.select(_answer(_ITEMS[source](w), source).alias("body")), source), source)


@registered(
    with_works(
        "SELECT lower('https://openalex.org/W' || seq) AS openalex, doi, coalesce(nullif(trim(title), ''), 'Unknown Title') AS title, year, cited_by_count, is_retracted, nullif(title, '') AS abstract, 'van ' || lang AS family, 'Ann' AS given, "
        f"'{ORCID}' AS orcid, 'Letters of ' || source_provider AS venue FROM works"
    )
)
def normalized_openalex(spark: SparkSession, d: str) -> DataFrame:
    """All works as OpenAlex answers, parsed and normalized: identifiers, names, inverted abstracts."""
    n = _normalized(spark, d, "openalex")
    first = F.get("authors", F.lit(0))
    return n.select(idf.find_namespace(F.col("ids"), "openalex").alias("openalex"), idf.find_namespace(F.col("ids"), "doi").alias("doi"), "title", "year", "cited_by_count", "is_retracted", "abstract", first["family"].alias("family"), first["given"].alias("given"), first["orcid"].alias("orcid"), F.col("venue.name").alias("venue"))


@registered(with_works("SELECT doi, trim(title) AS title, year, cited_by_count, CASE WHEN seq % 2 = 0 THEN 'journal' ELSE 'conference' END AS venue_type, 'Letters' AS venue, lang AS family FROM works WHERE trim(title) <> ''"))
def normalized_crossref(spark: SparkSession, d: str) -> DataFrame:
    """All works as Crossref answers; items without a title are left out, the year is that of either date."""
    n = _normalized(spark, d, "crossref")
    return n.select(idf.find_namespace(F.col("ids"), "doi").alias("doi"), "title", "year", "cited_by_count", F.col("venue.type").alias("venue_type"), F.col("venue.name").alias("venue"), F.get("authors", F.lit(0))["family"].alias("family"))


@registered(with_works("SELECT lower('P' || seq) AS s2, doi, arxiv, trim(title) AS title, year, cited_by_count, length(abstract) AS abstract_length, lang AS family FROM works WHERE trim(title) <> ''"))
def normalized_semantic_scholar(spark: SparkSession, d: str) -> DataFrame:
    n = _normalized(spark, d, "semantic_scholar")
    of = lambda ns: idf.find_namespace(F.col("ids"), ns).alias(ns)
    return n.select(of("s2"), of("doi"), of("arxiv"), "title", "year", "cited_by_count", F.char_length("abstract").cast("long").alias("abstract_length"), F.get("authors", F.lit(0))["family"].alias("family"))


@registered(with_works("SELECT lower('D' || seq) AS doaj, doi, trim(title) AS title, year, CASE WHEN seq % 2 = 0 THEN '1111-2222' ELSE '3333-4444' END AS issn, 'Open House' AS publisher, length(abstract) AS abstract_length, lang AS family FROM works WHERE trim(title) <> ''"))
def normalized_doaj(spark: SparkSession, d: str) -> DataFrame:
    """All works as DOAJ answers: typed identifiers, the electronic ISSN before the printed one."""
    w = works(spark, d)
    one = lambda kind, value: F.struct(value.alias("id"), F.lit(kind).alias("type"))
    known = F.array_compact(F.array(one("pissn", F.lit("3333-4444")), F.when(F.col("raw_doi").isNotNull(), one("doi", F.col("raw_doi"))), F.when(F.col("seq") % 2 == 0, one("eissn", F.lit("1111-2222")))))
    record = F.struct("title", F.col("year").cast("string").alias("year"), "abstract", known.alias("identifier"), F.array(F.struct(F.concat(F.col("lang"), F.lit(", Ann")).alias("name"))).alias("author"), F.struct(F.lit("Letters").alias("title"), F.lit("Open House").alias("publisher")).alias("journal"))
    bodies = w.select(_answer(F.struct(F.concat(F.lit("D"), F.col("seq").cast("string")).alias("id"), record.alias("bibjson")), "doaj").alias("body"))
    n = payloads.normalize(payloads.items_of(bodies, "doaj"), "doaj")
    of = lambda ns: idf.find_namespace(F.col("ids"), ns).alias(ns)
    return n.select(of("doaj"), of("doi"), "title", "year", F.col("venue.issn").alias("issn"), F.col("venue.publisher").alias("publisher"), F.char_length("abstract").cast("long").alias("abstract_length"), F.get("authors", F.lit(0))["family"].alias("family"))


@registered(with_works("SELECT CAST(seq AS VARCHAR) AS ieee, doi, trim(title) AS title, year, cited_by_count, 'Letters' AS venue, lang AS family FROM works WHERE trim(title) <> ''"))
def normalized_ieee(spark: SparkSession, d: str) -> DataFrame:
    w = works(spark, d)
    people = F.struct(F.array(F.struct(F.concat(F.lit("Ann "), F.col("lang")).alias("full_name"))).alias("authors"))
    item = F.struct(F.col("raw_doi").alias("doi"), F.col("seq").cast("string").alias("article_number"), "title", F.col("year").alias("publication_year"), "abstract", people.alias("authors"), F.lit("Letters").alias("publication_title"), F.col("cited_by_count").alias("citing_paper_count"))
    n = payloads.normalize(payloads.items_of(w.select(_answer(item, "ieee").alias("body")), "ieee"), "ieee")
    of = lambda ns: idf.find_namespace(F.col("ids"), ns).alias(ns)
    return n.select(of("ieee"), of("doi"), "title", "year", "cited_by_count", F.col("venue.name").alias("venue"), F.get("authors", F.lit(0))["family"].alias("family"))


#: Characters that XML cannot hold, or that its readers change.
_NO_XML = r"[\x00-\x08\x0B-\x1F]"


def _element(tag: str, value: Column | str, attributes: str = "") -> Column:
    value = F.coalesce((F.col(value) if isinstance(value, str) else value).cast("string"), F.lit(""))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        value = F.replace(value, F.lit(char), F.lit(entity))
    return F.concat(F.lit(f"<{tag}{attributes}>"), F.regexp_replace(value, _NO_XML, ""), F.lit(f"</{tag}>"))


@registered(with_works(rf"SELECT arxiv, trim(regexp_replace(t, '\s+', ' ', 'g')) AS title, year, lang AS family, length(trim(regexp_replace(regexp_replace(abstract, '{_NO_XML}', '', 'g'), '\s+', ' ', 'g'))) AS abstract_length FROM (SELECT *, regexp_replace(title, '{_NO_XML}', '', 'g') AS t FROM works) WHERE arxiv IS NOT NULL AND trim(t) <> ''"))
def normalized_arxiv(spark: SparkSession, d: str) -> DataFrame:
    """All works with an arXiv number as feed entries in XML: versions cut off, white space collapsed."""
    w = works(spark, d).where("raw_arxiv is not null")
    number = F.concat(F.lit("http://arxiv.org/abs/"), F.regexp_replace("raw_arxiv", "^arXiv:", ""), F.lit("v2"))
    author = F.concat(F.lit("<author>"), _element("name", F.concat(F.lit("Ann "), F.col("lang"))), F.lit("</author>"))
    entry = F.concat(F.lit("<feed><entry>"), _element("id", number), _element("title", "title"), _element("summary", "abstract"), _element("published", F.concat(F.col("year").cast("string"), F.lit("-05-01T00:00:00Z"))), author, author, F.lit("</entry></feed>"))
    n = payloads.normalize(payloads.items_of(w.select(entry.alias("body")), "arxiv"), "arxiv")
    return n.select(idf.find_namespace(F.col("ids"), "arxiv").alias("arxiv"), "title", "year", F.get("authors", F.lit(1))["family"].alias("family"), F.char_length("abstract").cast("long").alias("abstract_length"))


@registered(with_works(rf"SELECT CAST(seq AS VARCHAR) AS pubmed, doi, trim(t) AS title, CASE WHEN seq % 2 = 0 THEN year ELSE 1999 END AS year, lang AS family, '{ORCID}' AS orcid, 'Letters' AS venue FROM (SELECT *, regexp_replace(title, '{_NO_XML}', '', 'g') AS t FROM works) WHERE trim(t) <> ''"))
def normalized_pubmed(spark: SparkSession, d: str) -> DataFrame:
    """All works as PubMed articles in XML: dates in two forms, the DOI from either place, group authors left out."""
    w = works(spark, d)
    date = F.when(F.col("seq") % 2 == 0, _element("Year", F.col("year"))).otherwise(_element("MedlineDate", F.lit("1999 Jan-Feb")))
    people = F.concat(F.lit("<AuthorList><Author><CollectiveName>All</CollectiveName></Author><Author>"), _element("LastName", "lang"), _element("ForeName", F.lit("Ann")), _element("Identifier", F.lit(f"https://orcid.org/{ORCID}")), F.lit("</Author></AuthorList>"))
    has = F.col("raw_doi").isNotNull()
    inside = F.when(has & (F.col("seq") % 2 == 0), _element("ELocationID", "raw_doi", ' EIdType="doi"')).otherwise(F.lit(""))
    outside = F.when(has & (F.col("seq") % 2 != 0), F.concat(F.lit("<PubmedData><ArticleIdList>"), _element("ArticleId", "raw_doi", ' IdType="doi"'), F.lit("</ArticleIdList></PubmedData>"))).otherwise(F.lit(""))
    journal = F.concat(F.lit("<Journal>"), _element("Title", F.lit("Letters")), F.lit("<JournalIssue><PubDate>"), date, F.lit("</PubDate></JournalIssue></Journal>"))
    article = F.concat(F.lit("<Article>"), journal, _element("ArticleTitle", "title"), inside, people, F.lit("</Article>"))
    body = F.concat(F.lit("<Set><PubmedArticle><MedlineCitation>"), _element("PMID", F.col("seq")), article, F.lit("</MedlineCitation>"), outside, F.lit("</PubmedArticle></Set>"))
    n = payloads.normalize(payloads.items_of(w.select(body.alias("body")), "pubmed"), "pubmed")
    of = lambda ns: idf.find_namespace(F.col("ids"), ns).alias(ns)
    first = F.get("authors", F.lit(0))
    return n.select(of("pubmed"), of("doi"), "title", "year", first["family"].alias("family"), first["orcid"].alias("orcid"), F.col("venue.name").alias("venue"))


@registered(
    with_works(
        "SELECT source_provider, CAST(count(*) AS BIGINT) AS result_count, CAST(NULL AS VARCHAR) AS skip_reason, CAST(CASE source_provider WHEN 'openalex' THEN 40 ELSE 30 END AS BIGINT) AS latency_ms FROM works WHERE source_provider = 'openalex' OR (source_provider = 'crossref' AND trim(title) <> '') GROUP BY 1 UNION ALL SELECT 'ieee', 0, 'no key', 5"
    )
)
def federated_stats(spark: SparkSession, d: str) -> DataFrame:
    """What each source of a search gave: two answered page by page, one has no key."""
    w = works(spark, d)
    pages = lambda source, ms: w.where(F.col("source_provider") == source).select(F.lit(source).alias("source"), F.col("seq").cast("int").alias("page"), _answer(_ITEMS[source](w), source).alias("body"), F.lit(None).cast("string").alias("error"), F.lit(ms).cast("long").alias("latency_ms"))
    failed = spark.createDataFrame([("ieee", 0, None, "no key", 5)], "source string, page int, body string, error string, latency_ms long")
    result = search.federated(pages("openalex", 40).unionByName(pages("crossref", 30)).unionByName(failed), max_results=1 << 40)
    return result.stats.select("source_provider", "result_count", "skip_reason", "latency_ms")


# ---------------------------------------------------------------- store

_NAME = "CASE WHEN doi IS NOT NULL THEN 'doi:' || doi WHEN arxiv IS NOT NULL THEN 'arxiv:' || arxiv ELSE 'internal:' || seq END"


@registered(
    with_works(
        "SELECT id, title, year, CAST(1 + (arxiv IS NOT NULL)::INT + (doi IS NOT NULL)::INT AS BIGINT) AS n_ids FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS back FROM named) WHERE back = 1 AND NOT is_retracted",
        f"named AS (SELECT *, {_NAME} AS id FROM works)",
    )
)
def store_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Works saved, saved again and, where the newest record of a work is retracted, deleted with all that hangs on them; the rest
    read back with its identifiers.  Of records with one primary identifier the one retrieved last stays."""
    w = works(spark, d).withColumn("retrieved_at", F.timestamp_seconds("seq"))
    store = Store(spark, temporary_path(spark, "store"))
    store.save_works(w.where("seq % 3 = 0").withColumn("title", F.lit("an older title")))
    store.save_works(w)
    gone = store.read("works").where("is_retracted").select("id")
    store.delete_works(gone)
    found = store.find_works(store.read("works").select("id"))
    return found.select("id", "title", "year", F.size("ids").cast("long").alias("n_ids"))


@registered("SELECT query_id, provider, CAST(count(*) AS BIGINT) AS saves, arg_max(total_raw, event_id) AS total_raw FROM (SELECT CAST(user_id AS VARCHAR) AS query_id, event_type AS provider, CAST(floor(value) AS BIGINT) AS total_raw, event_id FROM events) GROUP BY 1, 2")
def provider_progress(spark: SparkSession, d: str) -> DataFrame:
    """The progress of every query with every provider, reported many times: the last report stays."""
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("query_id"), F.col("event_type").alias("provider"), F.floor("value").cast("long").alias("total_raw"), "event_id")
    store = Store(spark, temporary_path(spark, "store"))
    store.save_progress(e.where("event_id % 2 = 0"), "event_id")
    store.save_progress(e, "event_id")
    saves = e.groupBy("query_id", "provider").agg(F.count(F.lit(1)).alias("saves"))
    return store.read("search_query_providers").join(saves, ["query_id", "provider"]).select("query_id", "provider", "saves", "total_raw")


# ---------------------------------------------------------------- exports

def _cited_works(spark: SparkSession, d: str) -> DataFrame:
    w = works(spark, d)
    kind = F.when(F.col("seq") % 2 == 0, "conference").otherwise("journal")
    person = F.struct(F.col("lang").alias("family"), F.lit("Ann").alias("given"), F.lit(None).cast("string").alias("orcid"))
    return w.withColumn("venue", F.struct(F.lit("Letters & Notes").alias("name"), F.lit(None).cast("string").alias("issn"), kind.alias("type"))).withColumn("authors", F.array(person))


@registered(
    with_works(
        r"""SELECT 'TY  - ' || CASE WHEN seq % 2 = 0 THEN 'CONF' ELSE 'JOUR' END AS kind, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN title <> '' THEN length(title) + 7 ELSE 0 END) AS BIGINT) AS title_chars, CAST(count(doi) AS BIGINT) AS dois FROM works GROUP BY 1"""
    )
)
def export_ris(spark: SparkSession, d: str) -> DataFrame:
    """The bibliography in RIS, read again line by line: kinds, length of all title lines, DOIs."""
    text = export.ris(_cited_works(spark, d)).select(F.split("value", "\n").alias("lines"))
    line = lambda tag: F.get(F.filter("lines", lambda x: F.startswith(x, F.lit(tag))), F.lit(0))
    read = text.select(F.get("lines", F.lit(0)).alias("kind"), F.coalesce(F.char_length(line("TI  - ")) + 1, F.lit(0)).alias("chars"), line("DO  - ").alias("doi"))
    return read.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").cast("long").alias("title_chars"), F.count("doi").alias("dois"))


@registered(f"WITH {CITATIONS_SQL}, {NODES_SQL} SELECT 'node' AS kind, CAST(node AS VARCHAR) AS a, CAST(NULL AS VARCHAR) AS b FROM nodes UNION ALL SELECT 'edge', CAST(src AS VARCHAR), CAST(dst AS VARCHAR) FROM edges")
def export_graphml(spark: SparkSession, d: str) -> DataFrame:
    """The citation graph in GraphML, read again line by line."""
    from citeloom.operators import graph

    edges = citations(spark, d)
    nodes = graph.nodes_of(edges).withColumn("label", F.concat(F.lit("Part <"), F.col("node").cast("string"), F.lit(">")))
    lines = export.graphml(nodes, edges.withColumn("weight", F.lit(1.0))).where("value like '<node%' or value like '<edge%'")
    of = lambda name: F.nullif(F.regexp_extract("value", f'{name}="([^"]*)"', 1), F.lit(""))
    return lines.select(F.substring("value", 2, 4).alias("kind"), F.coalesce(of(" id"), of("source")).alias("a"), of("target").alias("b"))
