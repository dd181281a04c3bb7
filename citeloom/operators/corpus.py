"""A corpus of records with identity-aware set algebra; every order is total because each record has a ``seq``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions import identifiers as idf
from citeloom.functions import records
from citeloom.operators import skew
from citeloom.operators.components import connected_components
from citeloom.sources.scratch import stash


class Corpus:
    """Wraps a DataFrame with at least seq and ids (array of struct<ns,value>)."""

    def __init__(self, df: DataFrame):
        self.df = df

    # filters
    def filter(self, predicate: Column | Callable[[DataFrame], Column]) -> Corpus:
        return Corpus(self.df.where(predicate(self.df) if callable(predicate) and not isinstance(predicate, Column) else predicate))

    def retracted(self) -> Corpus:
        return self.filter(F.col("is_retracted"))

    def without_retracted(self) -> Corpus:
        return self.filter(~F.col("is_retracted"))

    def in_years(self, year_from: int | None = None, year_to: int | None = None) -> Corpus:
        """Pushed down to the scan: only the given bounds become predicates."""
        out = self.df
        if year_from is not None:
            out = out.where(F.col("year") >= year_from)
        if year_to is not None:
            out = out.where(F.col("year") <= year_to)
        return Corpus(out)

    def find_by_id(self, namespace: str, value: str) -> DataFrame:
        wanted = idf.normalize_value(F.lit(namespace), F.lit(value))
        return self.df.where(F.exists("ids", lambda x: (x["ns"] == namespace) & (x["value"] == wanted))).orderBy("seq").limit(1)

    def find_by_title(self, title: str) -> DataFrame:
        return self.df.where(F.lower(F.trim("title")) == title.strip().lower()).orderBy("seq").limit(1)

    # identity joins; internal identifiers count like any other
    def _ids(self) -> DataFrame:
        return self.df.select(F.explode("ids").alias("id")).distinct()

    def contains(self, other: Corpus) -> Corpus:
        """Records that share an identifier with the other corpus."""
        return self._identity(other, "left_semi")

    def subtract(self, other: Corpus) -> Corpus:
        return self._identity(other, "left_anti")

    def _identity(self, other: Corpus, kind: str) -> Corpus:
        mine = self.df.select("seq", F.explode("ids").alias("id")).join(other._ids(), "id", "left_semi").select("seq").distinct()
        return Corpus(self.df.join(mine, "seq", kind))

    def merge(self, other: Corpus, order: str = "identity") -> Corpus:
        """Identity-aware union: records connected through shared identifiers become one (see ``merge_by_identity``).  With
        ``order="arrival"`` each record joins the first that it matches, mine before the other's (see ``arrival``)."""
        if order == "arrival":
            from citeloom.operators.arrival import merge_in_order

            both = self.df.withColumn("_side", F.lit(0)).unionByName(other.df.withColumn("_side", F.lit(1)), allowMissingColumns=True)
            return Corpus(merge_in_order(both, [F.col("_side")]).drop("entry", "_side"))
        return Corpus(merge_by_identity(self.df.unionByName(other.df, allowMissingColumns=True)))

    def with_work(self, one: DataFrame, order: str = "identity") -> Corpus:
        return self.merge(Corpus(one), order)

    # order and pages
    def sort_by_year(self, descending: bool = True) -> DataFrame:
        return self._sorted("year", descending)

    def sort_by_citations(self, descending: bool = True) -> DataFrame:
        return self._sorted("cited_by_count", descending)

    def _sorted(self, column: str, descending: bool) -> DataFrame:
        key = F.coalesce(column, F.lit(0))
        return self.df.orderBy(key.desc() if descending else key, "seq")

    def top_cited(self, n: int = 15) -> DataFrame:
        return self.sort_by_citations().limit(n)

    def page(self, offset: int, size: int) -> DataFrame:
        return self.df.orderBy("seq").offset(offset).limit(size)

    def per_source(self, n: int) -> Corpus:
        rank = F.row_number().over(Window.partitionBy("source_provider").orderBy("seq"))
        return Corpus(self.df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank"))

    # aggregates
    def source_counts(self) -> DataFrame:
        return self.df.groupBy("source_provider").agg(F.count(F.lit(1)).alias("n"))

    def year_counts(self) -> DataFrame:
        return self.df.groupBy("year").agg(F.count(F.lit(1)).alias("n"))


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """Results of several sources, in their registration order, with a running ``seq`` from source rank and place."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def identity_groups(df: DataFrame) -> DataFrame:
    """seq, group: records that are connected through equal identifiers (group: the smallest seq)."""
    keyed = df.select("seq", F.explode("ids").alias("id"))
    star = keyed.groupBy("id").agg(F.min("seq").alias("first"))
    edges = keyed.join(star, "id").where("seq <> first").select(F.col("seq").alias("a"), F.col("first").alias("b"))
    parts = connected_components(edges)
    return df.select("seq").join(parts, df["seq"] == parts["node"], "left").select("seq", F.coalesce("component", "seq").alias("group"))


def merge_by_identity(df: DataFrame) -> DataFrame:
    """One record per identity group: the first record's fields, gaps filled from later ones, identifiers united.

    The closure is transitive; a merge into the first match, which can leave connected records apart, is in ``arrival``.
    """
    grouped = identity_groups(df).withColumnRenamed("seq", "_seq").join(df, F.col("_seq") == F.col("seq")).drop("_seq")
    return fuse(grouped, "group", [F.col("seq")])


def fuse(df: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """One record per value of ``by``: in the given order, first non-null fields, united identifiers, most citations.

    Pre-aggregated passes: the smallest (order, field) structs are kept, no window.  Equal identifiers of a group are
    reduced to the first one before they are gathered, so a group gathers no more than its row holds.
    """
    rank = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    plain = [c for c in df.columns if c not in (by, "ids", "cited_by_count")]
    lead = {"seq", "title", "source_provider", "is_retracted", "norm_title"}
    first = [(F.min_by(c, rank) if c in lead else F.min_by(c, F.when(F.col(c).isNotNull(), rank))).alias(c) for c in plain]
    cited = [F.max("cited_by_count").alias("cited_by_count")] if "cited_by_count" in df.columns else []
    each = df.select(F.col(by).alias("_by"), rank.alias("_rank"), F.posexplode("ids").alias("_place", "_id")).groupBy("_by", "_id").agg(F.min(F.struct("_rank", "_place")).alias("_at"))
    united = each.groupBy("_by").agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_id"))), lambda x: x["_id"]).alias("ids"))
    fused = df.groupBy(by).agg(*first, *cited).join(united, F.col(by) == F.col("_by"), "left").drop("_by")
    return fused.withColumn("ids", F.coalesce("ids", F.array().cast(df.schema["ids"].dataType)))


def shared_authors(authors: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of ``authors`` (with normalized) whose person the other list has too.  A name may be that of most rows."""
    return skew.semi_join(authors, other.select("normalized").distinct(), "normalized")


def shared_persons(authors: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of ``authors`` (with orcid and normalized) whose person the other list has: by ORCID if both have one, else by name.

    A disjunction of equalities, so equi-joins with an exclusion, over the different persons: those with an ORCID look for it, and
    those not found for the name of somebody without one; persons without an ORCID look for the name of anybody.  Rows are
    then joined with the persons found, so none travels but to its person.
    """
    orcids = other.where(F.col("orcid").isNotNull()).select("orcid").distinct()
    names = other.where(F.col("normalized").isNotNull()).groupBy("normalized").agg(F.bool_or(F.col("orcid").isNull()).alias("_open"))
    persons = stash(authors.select("orcid", "normalized").distinct(), "persons")
    known, unknown = persons.where(F.col("orcid").isNotNull()), persons.where(F.col("orcid").isNull())
    by_orcid = known.join(orcids, "orcid", "left_semi")
    by_open_name = known.join(orcids, "orcid", "left_anti").join(names.where("_open"), "normalized", "left_semi")
    by_name = unknown.join(names, "normalized", "left_semi")
    who = F.struct("orcid", "normalized").alias("_who")
    found = by_orcid.select(who).union(by_open_name.select(who)).union(by_name.select(who))
    return skew.semi_join(authors.withColumn("_who", who), found, "_who").select(*authors.columns)


def browse(works: DataFrame, sources: list[str] | None = None, year_from: int | None = None, year_to: int | None = None, open_access: bool | None = None, has_abstract: bool | None = None, min_completeness: int | None = None) -> DataFrame:
    """Records that meet all filters given (with is_open_access and completeness columns, where those are asked for)."""
    out = Corpus(works).in_years(year_from, year_to).df
    if sources is not None:
        out = out.where(F.col("source_provider").isin(sources))
    if open_access is not None:
        out = out.where(F.coalesce("is_open_access", F.lit(False)) == open_access)
    if has_abstract is not None:
        out = out.where(F.col("abstract").isNotNull() == has_abstract)
    if min_completeness is not None:
        out = out.where(F.col("completeness") >= min_completeness)
    return out


def exact_intersection(mine: Column, theirs: Column) -> Column:
    return records.intersect_authors(mine, theirs)
