"""Records as the self-contained payloads that a cache or a queue keeps, and back.

What the form does not hold is lost on the way: a venue's publisher and anything outside the fields below.  On the way
back identifiers get their normal form again, and a venue without a type is a journal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions import identifiers as idf
from citeloom.functions.text import atom_timestamp

#: Names and types of the payload.
PAYLOAD = (
    "ids array<struct<ns: string, val: string>>, title string, authors array<struct<family: string, given: string, orcid: string>>, year int, "
    "venue struct<name: string, issn: string, type: string>, abstract string, citedByCount int, isRetracted boolean, sourceProvider string, retrievedAt string, rawData string"
)


def to_payload(records: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and payload (JSON) of every record; fields that the records do not have are null."""
    has = lambda c, kind: F.col(c) if c in records.columns else F.lit(None).cast(kind)
    people = F.transform(has("authors", "array<struct<family:string,given:string,orcid:string>>"), lambda a: F.struct(a["family"].alias("family"), a["given"].alias("given"), a["orcid"].alias("orcid")))
    venue = has("venue", "struct<name:string,issn:string,type:string>")
    at = atom_timestamp(F.col("retrieved_at")) if "retrieved_at" in records.columns else F.lit(None).cast("string")
    fields = F.struct(
        F.transform("ids", lambda x: F.struct(x["ns"].alias("ns"), x["value"].alias("val"))).alias("ids"),
        "title",
        F.coalesce(people, F.array()).alias("authors"),
        "year",
        F.when(venue.isNotNull(), F.struct(venue["name"].alias("name"), venue["issn"].alias("issn"), venue["type"].alias("type"))).alias("venue"),
        has("abstract", "string").alias("abstract"),
        has("cited_by_count", "int").alias("citedByCount"),
        has("is_retracted", "boolean").alias("isRetracted"),
        F.col("source_provider").alias("sourceProvider"),
        at.alias("retrievedAt"),
        has("raw", "string").alias("rawData"),
    )
    return records.select(*keep, F.to_json(fields).alias("payload"))


def from_payload(payloads: DataFrame, *keep: str) -> DataFrame:
    """Records again; a payload that is no JSON object gives a row of nulls with no identifiers."""
    read = payloads.select(*keep, F.from_json("payload", PAYLOAD).alias("p"))
    venue = F.when(F.col("p.venue.name").isNotNull(), F.struct(F.col("p.venue.name").alias("name"), F.col("p.venue.issn").alias("issn"), F.coalesce("p.venue.type", F.lit("journal")).alias("type")))
    ids = F.filter(F.transform("p.ids", lambda x: F.when(x["val"].isNotNull(), F.struct(x["ns"].alias("ns"), idf.normalize_value(x["ns"], x["val"]).alias("value")))), lambda x: x.isNotNull() & x["ns"].isin(idf.NAMESPACES))
    return read.select(
        *keep,
        F.coalesce(ids, F.array().cast("array<struct<ns:string,value:string>>")).alias("ids"),
        F.col("p.title").alias("title"),
        F.col("p.authors").alias("authors"),
        F.col("p.year").alias("year"),
        venue.alias("venue"),
        F.col("p.abstract").alias("abstract"),
        F.col("p.citedByCount").alias("cited_by_count"),
        F.coalesce("p.isRetracted", F.lit(False)).alias("is_retracted"),
        F.col("p.sourceProvider").alias("source_provider"),
        F.col("p.rawData").alias("raw"),
    )
