"""Identifiers: normal forms, parsing, the primary identifier of a record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Namespaces, in the order in which a primary identifier is chosen; "internal" is never primary.
PRIMARY_ORDER = ["doi", "openalex", "s2", "arxiv", "pubmed", "ieee", "doaj"]
NAMESPACES = [*PRIMARY_ORDER, "internal"]


def normalize_doi(value: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(value), r"(?i)^(https?://(dx\.)?doi\.org/|doi:)", ""))


def normalize_arxiv(value: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(value), r"(?i)^arxiv:", ""))


def normalize_value(namespace: Column, value: Column) -> Column:
    return F.when(namespace == "doi", normalize_doi(value)).when(namespace == "arxiv", normalize_arxiv(value)).otherwise(F.lower(F.trim(value)))


def work_id(namespace: str, value: Column) -> Column:
    """struct<ns,value>, null where the value is null or blank."""
    clean = normalize_value(F.lit(namespace), value)
    return F.when(F.length(clean) > 0, F.struct(F.lit(namespace).alias("ns"), clean.alias("value")))


def id_set(*ids: Column) -> Column:
    """The non-null identifiers in the order given."""
    return F.filter(F.array(*ids), lambda x: x.isNotNull())


def id_string(work: Column) -> Column:
    return F.concat_ws(":", work["ns"], work["value"])


def ids_string(ids: Column) -> Column:
    return F.array_join(F.transform(ids, id_string), "|")


def parse_id(text: Column) -> Column:
    """struct<ns,value> of "ns:value", cut at the first colon; null for an unknown namespace or without a colon."""
    parts = F.split(text, ":", 2)
    ns = F.lower(F.trim(parts[0]))
    ok = (F.size(parts) == 2) & ns.isin(NAMESPACES)
    return F.when(ok, F.struct(ns.alias("ns"), normalize_value(ns, F.get(parts, F.lit(1))).alias("value")))


def find_namespace(ids: Column, namespace: str) -> Column:
    """Value of the first identifier in a namespace."""
    return F.get(F.filter(ids, lambda x: x["ns"] == namespace), F.lit(0))["value"]


def primary(ids: Column) -> Column:
    """struct<ns,value> by precedence; null if only internal identifiers are there."""
    in_namespace = lambda ns: F.get(F.filter(ids, lambda x: x["ns"] == ns), F.lit(0))
    return F.coalesce(*[in_namespace(ns) for ns in PRIMARY_ORDER])


def merge_ids(a: Column, b: Column) -> Column:
    """Ordered union without repeats."""
    return F.array_union(a, b)


def intersect_ids(a: Column, b: Column) -> Column:
    return F.array_intersect(a, b)


def overlap(a: Column, b: Column) -> Column:
    """Namespace and value equal for any pair."""
    return F.arrays_overlap(a, b)


def valid_orcid(text: Column) -> Column:
    return text.rlike(r"^\d{4}-\d{4}-\d{4}-\d{3}[\dX]$")


def valid_language(text: Column) -> Column:
    return text.rlike(r"^[a-z]{2}(-[A-Z]{2})?$")
