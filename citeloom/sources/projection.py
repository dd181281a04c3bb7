"""Bibliographic tables read off the synthetic star schema, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import identifiers as ids
from citeloom.functions.records import SOURCES
from citeloom.functions.text import normalize_author, normalize_title, parse_author

FIRST_SENTENCE, FIRST_LINE = r"^[^.\n]*", r"^[^\n]*"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, title, abstract, year, cited_by_count, is_retracted, source_provider, raw_doi, ids, norm_title.

    A text's first sentence is the title, all that follows it the abstract; the DOI is made of the whole text and the arXiv number of
    its first line.
    """
    docs = table(spark, sf_dir, "documents").withColumn("title", F.regexp_extract("text", FIRST_SENTENCE, 0))
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    raw = F.concat(F.lit("10.5555/"), F.substring(F.md5(F.col("text").cast("binary")), 1, 12))
    spelled = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("https://doi.org/"), raw)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("DOI:"), F.upper(raw))).otherwise(raw)
    arxiv = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("arXiv:"), F.substring(F.md5(F.regexp_extract("text", FIRST_LINE, 0).cast("binary")), 1, 10)))
    out = docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("seq"),
        "title",
        F.nullif(F.trim(F.substring("text", F.char_length("title") + 2, F.char_length("text"))), F.lit("")).alias("abstract"),
        (2000 + F.col("n_chars") % 26).cast("int").alias("year"),
        F.when(F.col("doc_id") % 7 != 0, (F.col("n_chars") % 500).cast("int")).alias("cited_by_count"),
        (F.coalesce("toxic", F.lit(0)) == 1).alias("is_retracted"),
        F.get(F.array(*[F.lit(s) for s in SOURCES]), F.substring("source", 4, 9).cast("int") % 7).alias("source_provider"),
        F.when(F.col("doc_id") % 5 != 4, spelled).alias("raw_doi"),
        arxiv.alias("raw_arxiv"),
        "lang",
    )
    every = ids.id_set(ids.work_id("doi", F.col("raw_doi")), ids.work_id("arxiv", F.col("raw_arxiv")), ids.work_id("internal", F.col("seq").cast("string")))
    return out.withColumn("ids", every).withColumn("norm_title", normalize_title(F.col("title")))


def work_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, position, name, family, normalized: suppliers of an order's lines."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    joined = lines.join(persons_of(spark, sf_dir), "l_suppkey")
    return joined.select(F.col("l_orderkey").alias("seq"), F.col("l_linenumber").alias("position"), "name", parse_author(F.col("name"))["family"].alias("family"), "normalized")


def persons_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_suppkey, name, normalized: suppliers as persons."""
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("name"))
    return names.withColumn("normalized", normalize_author(F.col("name")))


def authored(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """seq, position, the person's key, mine: an order's lines, and whether it is finished; keys and numbers alone travel."""
    status = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), (F.col("o_orderstatus") == "F").alias("mine"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("seq"), F.col("l_linenumber").alias("position"), key)
    return lines.join(status, "seq")


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: distinct, no loops."""
    n = table(spark, sf_dir, "part").count()
    lines = table(spark, sf_dir, "lineitem")
    return lines.select((F.col("l_orderkey") % n).alias("src"), F.col("l_partkey").alias("dst")).where("src <> dst").distinct()


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project, work, stage, decision, decided_by, decided_at: an append-only log read off the events."""
    e = table(spark, sf_dir, "events")
    stage = F.get(F.array(F.lit("title_abstract"), F.lit("full_text"), F.lit("final")), (F.col("user_id") % 3).cast("int"))
    decision = F.get(F.array(F.lit("include"), F.lit("exclude"), F.lit("maybe"), F.lit("conflict")), (F.floor(F.col("value")).cast("long") % 4).cast("int"))
    return e.select((F.col("user_id") % 5).alias("project"), (F.col("event_id") % 997).alias("work"), stage.alias("stage"), decision.alias("decision"), F.col("user_id").alias("decided_by"), F.col("ts").alias("decided_at"), F.col("event_id").alias("decision_id"), "event_type", "props")


# ---------------------------------------------------------------- the same in SQL (DuckDB)

def norm_sql(title: str) -> str:
    from citeloom.functions.text import ENTITIES, REFERENCE, SPELLED

    out = f"lower({title})"
    for entity, char in ENTITIES.items():
        if entity != "&amp;":
            out = "replace({}, '{}', '{}')".format(out, entity, char.replace("'", "''"))
    out = f"replace({out}, '&amp;', '&')"
    number = f"regexp_extract(p, '{REFERENCE}', 1)"
    code = f"CASE WHEN {number} LIKE 'x%' THEN TRY_CAST('0' || {number} AS INTEGER) ELSE TRY_CAST({number} AS INTEGER) END"
    decoded = f"CASE WHEN ({code}) BETWEEN 1 AND 55295 OR ({code}) BETWEEN 57344 AND 1114111 THEN chr({code}) || substr(p, length({number}) + 2) ELSE '&#' || p END"
    parts = f"string_split({out}, '&#')"
    out = f"CASE WHEN contains({out}, '&#') THEN {parts}[1] || array_to_string([{decoded} for p in {parts}[2:]], '') ELSE {out} END"
    out = f"lower(regexp_replace({out}, '&[a-z0-9#]+;', ' ', 'g'))"
    for letter, plain in SPELLED.items():
        out = f"replace({out}, '{letter}', '{plain}')"
    return f"trim(regexp_replace(regexp_replace(strip_accents({out}), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'))"


WORKS_SQL = f"""works AS (
  SELECT d.doc_id AS seq, d.title, nullif(trim(substr(d.text, length(d.title) + 2)), '') AS abstract, CAST(2000 + d.n_chars % 26 AS INTEGER) AS year,
    CASE WHEN d.doc_id % 7 <> 0 THEN CAST(d.n_chars % 500 AS INTEGER) END AS cited_by_count, coalesce(l.toxic, 0) = 1 AS is_retracted,
    ['arxiv', 'crossref', 'doaj', 'ieee', 'openalex', 'pubmed', 'semantic_scholar'][1 + CAST(substr(d.source, 4) AS INTEGER) % 7] AS source_provider,
    CASE WHEN d.doc_id % 5 <> 4 THEN '10.5555/' || substr(md5(d.text), 1, 12) END AS doi,
    CASE WHEN d.doc_id % 4 = 0 THEN substr(md5(regexp_extract(d.text, '{FIRST_LINE}', 0)), 1, 10) END AS arxiv, d.lang,
    {norm_sql("d.title")} AS norm_title
  FROM (SELECT *, regexp_extract(text, '{FIRST_SENTENCE}', 0) AS title FROM documents) d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""

CITATIONS_SQL = """edges AS (
  SELECT DISTINCT l_orderkey % (SELECT count(*) FROM part) AS src, l_partkey AS dst FROM lineitem WHERE l_orderkey % (SELECT count(*) FROM part) <> l_partkey
)"""

AUTHORS_SQL = """authors AS (
  SELECT l_orderkey AS seq, l_linenumber AS position, s_name AS name, list_last(string_split_regex(trim(s_name), '\\s+')) AS family,
    trim(regexp_replace(regexp_replace(strip_accents(lower(s_name)), '[^a-z\\s]', '', 'g'), '\\s+', ' ', 'g')) AS normalized
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
)"""

DECISIONS_SQL = """decisions AS (
  SELECT user_id % 5 AS project, event_id % 997 AS work, ['title_abstract', 'full_text', 'final'][1 + user_id % 3] AS stage,
    ['include', 'exclude', 'maybe', 'conflict'][1 + CAST(floor(value) AS BIGINT) % 4] AS decision, user_id AS decided_by, ts AS decided_at, event_id AS decision_id, event_type, props
  FROM events
)"""
