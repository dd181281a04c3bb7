"""Normalizing recorded payloads of seven scholarly sources into one record schema.

Each source has an explicit schema of the fields that are read (so scans prune columns and a lone element never changes
a type), a scan that explodes its items, and a normalizer of Column expressions; no Python runs on a row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import identifiers as idf
from citeloom.functions.records import SOURCES
from citeloom.functions.text import normalize_author, parse_author

OPENALEX = "id string, ids struct<openalex:string,doi:string,mag:string,pmid:string,arxiv:string>, title string, display_name string, publication_year int, cited_by_count int, is_retracted boolean, primary_location struct<source:struct<display_name:string,issn_l:string,type:string>>, authorships array<struct<author:struct<display_name:string,orcid:string>>>, abstract_inverted_index map<string,array<int>>"
CROSSREF = "DOI string, title array<string>, author array<struct<given:string,family:string,ORCID:string>>, published struct<`date-parts`:array<array<int>>>, `published-print` struct<`date-parts`:array<array<int>>>, `container-title` array<string>, ISSN array<string>, publisher string, type string, `is-referenced-by-count` int"
S2 = "paperId string, externalIds struct<DOI:string,ArXiv:string,PubMed:string>, title string, abstract string, year int, venue string, authors array<struct<name:string>>, citationCount int"
DOAJ = "id string, bibjson struct<title:string,year:string,abstract:string,identifier:array<struct<id:string,type:string>>,author:array<struct<name:string>>,journal:struct<title:string,publisher:string>>"
IEEE = "doi string, article_number string, title string, publication_year int, abstract string, authors struct<authors:array<struct<full_name:string>>>, publication_title string, issn string, citing_paper_count int"
ARXIV = "id string, title string, summary string, published string, author array<struct<name:string>>"
PUBMED = "MedlineCitation struct<PMID:string,Article:struct<ArticleTitle:string,Abstract:struct<AbstractText:array<string>>,AuthorList:struct<Author:array<struct<LastName:string,ForeName:string,Identifier:string>>>,Journal:struct<Title:string,ISSN:string,JournalIssue:struct<PubDate:struct<Year:string,MedlineDate:string>>>,ELocationID:array<struct<_EIdType:string,_VALUE:string>>>>, PubmedData struct<ArticleIdList:struct<ArticleId:array<struct<_IdType:string,_VALUE:string>>>>"
#: Where the items of a search answer are.
SCHEMAS = {"openalex": "results array<struct<{}>>", "crossref": "message struct<items:array<struct<{}>>>", "semantic_scholar": "data array<struct<{}>>, token string", "doaj": "results array<struct<{}>>", "ieee": "articles array<struct<{}>>"}
FIELDS = {"openalex": OPENALEX, "crossref": CROSSREF, "semantic_scholar": S2, "doaj": DOAJ, "ieee": IEEE, "arxiv": ARXIV, "pubmed": PUBMED}
ITEMS = {"openalex": "results", "crossref": "message.items", "semantic_scholar": "data", "doaj": "results", "ieee": "articles"}
ROW_TAGS = {"arxiv": "entry", "pubmed": "PubmedArticle"}
#: The kinds of venue by the type of a Crossref item.
CROSSREF_TYPES = {"journal-article": "journal", "proceedings-article": "conference", "book-chapter": "book", "posted-content": "repository"}


def as_struct(fields: str) -> str:
    """A top-level DDL schema as the inside of a struct<...> type."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(fields + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            name, kind = fields[start:i].strip().split(" ", 1)
            out.append(f"{name}:{kind}")
            start = i + 1
    return ",".join(out)


def scan(spark: SparkSession, source: str, path: str) -> DataFrame:
    """The items of recorded answers, one row each, in order of file and place."""
    if source in ROW_TAGS:
        return spark.read.format("xml").option("rowTag", ROW_TAGS[source]).schema(FIELDS[source]).load(path)
    pages = spark.read.option("multiLine", True).schema(SCHEMAS[source].format(as_struct(FIELDS[source]))).json(path)
    return pages.select(F.explode(ITEMS[source]).alias("item")).select("item.*")


def items_of(pages: DataFrame, source: str) -> DataFrame:
    """The items of answers held in a column ``body``, one row each; a body that cannot be read has none."""
    if source in ROW_TAGS:
        tag = ROW_TAGS[source]
        read = pages.select(F.from_xml("body", f"{tag} array<struct<{as_struct(FIELDS[source])}>>").alias("page"))
        return read.select(F.explode(F.col(f"page.{tag}")).alias("item")).select("item.*")
    read = pages.select(F.from_json("body", SCHEMAS[source].format(as_struct(FIELDS[source]))).alias("page")).select("page.*")
    return read.select(F.explode(ITEMS[source]).alias("item")).select("item.*")


def _blank(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _venue(name: Column, issn: Column | None = None, kind: Column | str | None = None, publisher: Column | None = None) -> Column:
    null = F.lit(None).cast("string")
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.when(_blank(name).isNotNull(), F.struct(_blank(name).alias("name"), (null if issn is None else _blank(issn)).alias("issn"), (null if kind is None else kind).alias("type"), (null if publisher is None else _blank(publisher)).alias("publisher")))


def _person(family: Column, given: Column | None = None, orcid: Column | None = None) -> Column:
    null = F.lit(None).cast("string")
    given = null if given is None else _blank(given)
    bare = null if orcid is None else F.regexp_replace(orcid, r"^.*orcid\.org/", "")
    good = F.when(idf.valid_orcid(bare), bare)
    return F.struct(family.alias("family"), given.alias("given"), good.alias("orcid"), normalize_author(F.concat_ws(" ", given, family)).alias("normalized"))


def _parsed(name: Column) -> Column:
    p = parse_author(name)
    return _person(p["family"], p["given"])


def _authors(people: Column, one: Callable[[Column], Column]) -> Column:
    return F.coalesce(F.filter(F.transform(people, one), lambda a: F.length(F.trim(a["family"])) > 0), F.array())


def abstract_of_index(index: Column) -> Column:
    """{word: [places]} as a text.  Of two words on one place, the one that sorts last is kept."""
    spots = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    ordered = F.sort_array(spots)
    # beside the next one, not looked up: an array that a lambda names is made again for each element
    last = F.filter(F.zip_with(ordered, F.slice(ordered, F.lit(2), F.size(ordered)), lambda x, y: F.struct(x["w"].alias("w"), y["p"].eqNullSafe(x["p"]).alias("again"))), lambda x: ~x["again"])
    return F.nullif(F.array_join(F.transform(last, lambda x: x["w"]), " "), F.lit(""))


def _openalex() -> dict[str, Column]:
    def author(a: Column) -> Column:
        words = F.split(F.trim(a["author"]["display_name"]), " ", 2)  # the first word is the given name
        family = F.coalesce(F.get(words, F.lit(1)), F.get(words, F.lit(0)))
        return _person(family, F.when(F.size(words) > 1, F.get(words, F.lit(0))), a["author"]["orcid"])

    place = F.col("primary_location.source")
    return {
        "ids": idf.id_set(idf.work_id("doi", F.col("ids.doi")), idf.work_id("openalex", F.coalesce("ids.openalex", "id")), idf.work_id("pubmed", F.col("ids.pmid")), idf.work_id("arxiv", F.col("ids.arxiv"))),
        "title": F.coalesce(_blank(F.col("display_name")), _blank(F.col("title")), F.lit("Unknown Title")),
        "authors": _authors(F.col("authorships"), author),
        "year": F.col("publication_year"),
        "venue": _venue(place["display_name"], place["issn_l"], place["type"]),
        "abstract": abstract_of_index(F.col("abstract_inverted_index")),
        "cited_by_count": F.col("cited_by_count"),
        "is_retracted": F.coalesce("is_retracted", F.lit(False)),
    }


def _crossref() -> dict[str, Column]:
    first = lambda c: F.get(F.col(c), F.lit(0))
    year = lambda c: F.get(F.get(F.col(f"{c}.`date-parts`"), F.lit(0)), F.lit(0))
    kinds = F.create_map(*[F.lit(x) for pair in CROSSREF_TYPES.items() for x in pair])
    return {
        "ids": idf.id_set(idf.work_id("doi", F.col("DOI"))),
        "title": _blank(first("title")),
        "authors": _authors(F.filter(F.col("author"), lambda a: a["family"].isNotNull()), lambda a: _person(a["family"], a["given"], a["ORCID"])),
        "year": F.coalesce(year("published"), year("`published-print`")),
        "venue": _venue(first("`container-title`"), first("ISSN"), F.element_at(kinds, F.col("type")), F.col("publisher")),
        "abstract": F.lit(None).cast("string"),
        "cited_by_count": F.col("`is-referenced-by-count`"),
        "is_retracted": F.lit(False),
    }


def _semantic_scholar() -> dict[str, Column]:
    ext = F.col("externalIds")
    return {
        "ids": idf.id_set(idf.work_id("doi", ext["DOI"]), idf.work_id("s2", F.col("paperId")), idf.work_id("arxiv", ext["ArXiv"]), idf.work_id("pubmed", ext["PubMed"])),
        "title": _blank(F.col("title")),
        "authors": _authors(F.col("authors"), lambda a: _parsed(a["name"])),
        "year": F.col("year"),
        "venue": _venue(F.col("venue")),
        "abstract": _blank(F.col("abstract")),
        "cited_by_count": F.col("citationCount"),
        "is_retracted": F.lit(False),
    }


def _doaj() -> dict[str, Column]:
    of = lambda kind: F.get(F.filter(F.col("bibjson.identifier"), lambda x: x["type"] == kind), F.lit(0))["id"]
    return {
        "ids": idf.id_set(idf.work_id("doi", of("doi")), idf.work_id("doaj", F.col("id"))),
        "title": _blank(F.col("bibjson.title")),
        "authors": _authors(F.col("bibjson.author"), lambda a: _parsed(a["name"])),
        "year": F.nullif(F.regexp_extract("bibjson.year", r"(\d{4})", 1), F.lit("")).cast("int"),
        "venue": _venue(F.col("bibjson.journal.title"), F.coalesce(of("eissn"), of("pissn")), "journal", F.col("bibjson.journal.publisher")),
        "abstract": _blank(F.col("bibjson.abstract")),
        "cited_by_count": F.lit(None).cast("int"),
        "is_retracted": F.lit(False),
    }


def _ieee() -> dict[str, Column]:
    return {
        "ids": idf.id_set(idf.work_id("doi", F.col("doi")), idf.work_id("ieee", F.col("article_number"))),
        "title": _blank(F.col("title")),
        "authors": _authors(F.col("authors.authors"), lambda a: _parsed(a["full_name"])),
        "year": F.col("publication_year"),
        "venue": _venue(F.col("publication_title"), F.col("issn")),
        "abstract": _blank(F.col("abstract")),
        "cited_by_count": F.col("citing_paper_count"),
        "is_retracted": F.lit(False),
    }


def _arxiv() -> dict[str, Column]:
    number = F.regexp_replace(F.regexp_extract("id", r"abs/([^\sv]+)", 1), r"v\d+$", "")
    return {
        "ids": idf.id_set(idf.work_id("arxiv", number)),
        "title": _blank(F.regexp_replace("title", r"\s+", " ")),
        "authors": _authors(F.col("author"), lambda a: _parsed(a["name"])),
        "year": F.nullif(F.regexp_extract("published", r"^(\d{4})", 1), F.lit("")).cast("int"),
        "venue": _venue(F.lit("arXiv"), kind="repository"),
        "abstract": _blank(F.regexp_replace("summary", r"\s+", " ")),
        "cited_by_count": F.lit(None).cast("int"),
        "is_retracted": F.lit(False),
    }


def _pubmed() -> dict[str, Column]:
    article = F.col("MedlineCitation.Article")
    of = lambda items, key, kind: F.get(F.filter(items, lambda x: x[key] == kind), F.lit(0))["_VALUE"]
    date = article["Journal"]["JournalIssue"]["PubDate"]
    return {
        "ids": idf.id_set(idf.work_id("doi", F.coalesce(of(article["ELocationID"], "_EIdType", "doi"), of(F.col("PubmedData.ArticleIdList.ArticleId"), "_IdType", "doi"))), idf.work_id("pubmed", F.col("MedlineCitation.PMID"))),
        "title": _blank(article["ArticleTitle"]),
        "authors": _authors(F.filter(article["AuthorList"]["Author"], lambda a: a["LastName"].isNotNull()), lambda a: _person(a["LastName"], a["ForeName"], a["Identifier"])),
        "year": F.coalesce(F.expr("try_cast(MedlineCitation.Article.Journal.JournalIssue.PubDate.Year as int)"), F.nullif(F.regexp_extract(date["MedlineDate"], r"(\d{4})", 1), F.lit("")).cast("int")),
        "venue": _venue(article["Journal"]["Title"], article["Journal"]["ISSN"], "journal"),
        "abstract": _blank(F.array_join(article["Abstract"]["AbstractText"], " ")),
        "cited_by_count": F.lit(None).cast("int"),
        "is_retracted": F.lit(False),
    }


NORMALIZERS: dict[str, Callable[[], dict[str, Column]]] = {"openalex": _openalex, "crossref": _crossref, "semantic_scholar": _semantic_scholar, "doaj": _doaj, "ieee": _ieee, "arxiv": _arxiv, "pubmed": _pubmed}


def normalize(items: DataFrame, source: str, with_raw: bool = False, retrieved_at: Column | None = None) -> DataFrame:
    """Records of the items; items without a title are dropped.  Raw data are kept only if asked for."""
    columns = NORMALIZERS[source]()
    out = items.select(
        *[c.alias(name) for name, c in columns.items()],
        F.lit(source).alias("source_provider"),
        F.lit(SOURCES.index(source) + 1).alias("source_rank"),
        (retrieved_at if retrieved_at is not None else F.current_timestamp()).alias("retrieved_at"),
        *([F.to_json(F.struct("*")).alias("raw_data")] if with_raw else []),
    )
    return out.where("title is not null")


def fetch_by_id(frames: dict[str, DataFrame], namespace: str, value: str, only: list[str] | None = None) -> DataFrame:
    """The first source, in registration order, that knows the identifier."""
    by_doi = [s for s in SOURCES if s != "arxiv"]
    supports = {"doi": by_doi, "arxiv": ["arxiv", "openalex", "semantic_scholar"], "openalex": ["openalex"], "s2": ["semantic_scholar"], "pubmed": ["pubmed", "openalex", "semantic_scholar", "crossref"], "ieee": ["ieee"], "doaj": ["doaj"]}
    wanted = idf.normalize_value(F.lit(namespace), F.lit(value))
    found = [frames[s].where(F.exists("ids", lambda x: (x["ns"] == namespace) & (x["value"] == wanted))) for s in SOURCES if s in frames and s in supports.get(namespace, []) and (not only or s in only)]
    if not found:
        return next(iter(frames.values())).limit(0)
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out.orderBy("source_rank").limit(1)
