"""Expressions over records: completeness, kinds, ranges, identity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Election priority of the sources; others have 0.
SOURCE_PRIORITY = {"openalex": 5, "crossref": 4, "semantic_scholar": 3, "arxiv": 2, "pubmed": 2, "ieee": 1, "doaj": 1}
#: Registration order of the sources.
SOURCES = ["arxiv", "crossref", "doaj", "ieee", "openalex", "pubmed", "semantic_scholar"]


def completeness(has_doi: Column, abstract: Column, has_venue: Column, has_authors: Column, year: Column, cited: Column, retracted: Column, has_orcid: Column) -> Column:
    """0 to 10: DOI 2, abstract 2, venue, authors, year, citations and not retracted 1 each, an ORCID 1, at most 10."""
    one = lambda c, n=1: F.when(c, n).otherwise(0)
    base = one(has_doi, 2) + one(abstract.isNotNull(), 2) + one(has_venue) + one(has_authors) + one(year.isNotNull()) + one(cited.isNotNull()) + one(~retracted)
    return F.least(base, F.lit(10)) + one(has_orcid)


def priority(source: Column) -> Column:
    out = F.lit(0)
    for name, n in SOURCE_PRIORITY.items():
        out = F.when(source == name, n).otherwise(out)
    return out


def source_rank(source: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SOURCES]), source).cast("int")


def year_in(year: Column, year_from: Column, year_to: Column) -> Column:
    """Inclusive, open where a bound is null."""
    return (year_from.isNull() | (year >= year_from)) & (year_to.isNull() | (year <= year_to))


def ranges_overlap(a_from: Column, a_to: Column, b_from: Column, b_to: Column) -> Column:
    low, high = F.lit(-(1 << 31)), F.lit((1 << 31) - 1)
    return (F.coalesce(a_from, low) <= F.coalesce(b_to, high)) & (F.coalesce(b_from, low) <= F.coalesce(a_to, high))


def unbounded(year_from: Column, year_to: Column) -> Column:
    return year_from.isNull() & year_to.isNull()


def is_preprint(source: Column, venue_type: Column) -> Column:
    return (source == "arxiv") | F.coalesce(venue_type == "repository", F.lit(False))


def identity_level(has_doi: Column, has_arxiv_or_s2: Column) -> Column:
    return F.when(has_doi, "High").when(has_arxiv_or_s2, "Medium").otherwise("Low")


def high_confidence(value: Column) -> Column:
    return value >= 0.95


def same_person(a_orcid: Column, b_orcid: Column, a_name: Column, b_name: Column) -> Column:
    """By ORCID if both have one, by normalized name otherwise."""
    return F.when(a_orcid.isNotNull() & b_orcid.isNotNull(), a_orcid == b_orcid).otherwise(F.coalesce(a_name == b_name, F.lit(False)))


def intersect_authors(mine: Column, theirs: Column) -> Column:
    """My authors (struct<..., orcid, normalized>) whom the other list also holds."""
    return F.filter(mine, lambda a: F.exists(theirs, lambda b: same_person(a["orcid"], b["orcid"], a["normalized"], b["normalized"])))


def has_venue(venue: Column) -> Column:
    return venue.isNotNull()


def venue_is(venue: Column, kind: str) -> Column:
    """Whether a venue (struct with type) is a "journal" or "conference"; false without one."""
    return F.coalesce(venue["type"] == kind, F.lit(False))
