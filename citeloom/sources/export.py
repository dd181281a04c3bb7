"""Exports of bibliographies and graphs, one text column per item, to be written with ``write.text``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions import identifiers as idf


def _authors(separator: str) -> Column:
    return F.array_join(F.transform("authors", lambda a: F.concat_ws(", ", a["family"], a["given"])), separator)


def _key() -> Column:
    p = idf.primary(F.col("ids"))
    return F.coalesce(F.regexp_replace(idf.id_string(p), r"[^A-Za-z0-9]+", "_"), F.concat(F.lit("work_"), F.col("seq").cast("string")))


def _line(pattern: str, value: Column) -> Column:
    """The line, or null where the value is null or empty."""
    return F.when(F.length(value.cast("string")) > 0, F.format_string(pattern, value.cast("string")))


def bibtex(works: DataFrame) -> DataFrame:
    escape = lambda c: F.regexp_replace(c, r"([&%$#_{}])", r"\\$1")
    kind = F.when(F.col("venue.type") == "conference", "inproceedings").when(F.col("venue.type") == "book", "incollection").when(F.col("venue.type") == "repository", "misc").otherwise("article")
    lines = F.array_compact(F.array(_line("  title = {%s}", escape("title")), _line("  author = {%s}", escape(_authors(" and "))), _line("  year = {%s}", F.col("year")), _line("  journal = {%s}", escape(F.col("venue.name"))), _line("  doi = {%s}", idf.find_namespace(F.col("ids"), "doi"))))
    return works.orderBy("seq").select(F.concat(F.lit("@"), kind, F.lit("{"), _key(), F.lit(",\n"), F.array_join(lines, ",\n"), F.lit("\n}")).alias("value"))


def ris(works: DataFrame) -> DataFrame:
    kind = F.when(F.col("venue.type") == "conference", "CONF").when(F.col("venue.type") == "book", "CHAP").otherwise("JOUR")
    people = F.transform("authors", lambda a: F.concat(F.lit("AU  - "), F.concat_ws(", ", a["family"], a["given"])))
    lines = F.concat(F.array(F.concat(F.lit("TY  - "), kind)), F.array_compact(F.array(_line("TI  - %s", F.col("title")))), people, F.array_compact(F.array(_line("PY  - %s", F.col("year")), _line("JO  - %s", F.col("venue.name")), _line("AB  - %s", F.regexp_replace("abstract", r"\s+", " ")), _line("DO  - %s", idf.find_namespace(F.col("ids"), "doi")))), F.array(F.lit("ER  - ")))
    return works.orderBy("seq").select(F.array_join(lines, "\n").alias("value"))


def flat(works: DataFrame) -> DataFrame:
    """Columns for ``write.csv``."""
    return works.orderBy("seq").select(idf.ids_string(F.col("ids")).alias("ids"), "title", _authors("; ").alias("authors"), "year", F.col("venue.name").alias("venue"), "cited_by_count", "is_retracted")


def json_lines(works: DataFrame) -> DataFrame:
    return works.orderBy("seq").select(F.to_json(F.struct(*[c for c in works.columns if c != "raw_data"])).alias("value"))


def _xml(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    out = c.cast("string")
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def _ordered(parts: list[tuple[int, DataFrame]]) -> DataFrame:
    """Lines of the parts in order; sorted by (part, id), so the file is the same on every run."""
    out = None
    for n, df in parts:
        df = df.select(F.lit(n).alias("part"), F.col("k").cast("string").alias("k"), "value")
        out = df if out is None else out.union(df)
    return out.orderBy("part", "k", "value").select("value")


def _text(df: DataFrame, value: str) -> DataFrame:
    return df.sparkSession.createDataFrame([("", value)], "k string, value string")


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes: node, label; edges: src, dst, weight."""
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="label" for="node" attr.name="label" attr.type="string"/><key id="weight" for="edge" attr.name="weight" attr.type="double"/><graph edgedefault="directed">'
    n = nodes.select(F.col("node").alias("k"), F.format_string('<node id="%s"><data key="label">%s</data></node>', _xml("node"), _xml("label")).alias("value"))
    e = edges.select(F.concat_ws("\t", "src", "dst").alias("k"), F.format_string('<edge source="%s" target="%s"><data key="weight">%s</data></edge>', _xml("src"), _xml("dst"), F.col("weight").cast("string")).alias("value"))
    return _ordered([(0, _text(nodes, head)), (1, n), (2, e), (3, _text(nodes, "</graph></graphml>"))])


def gexf(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.select(F.col("node").alias("k"), F.format_string('<node id="%s" label="%s"/>', _xml("node"), _xml("label")).alias("value"))
    e = edges.select(F.concat_ws("\t", "src", "dst").alias("k"), F.format_string('<edge source="%s" target="%s" weight="%s"/>', _xml("src"), _xml("dst"), F.col("weight").cast("string")).alias("value"))
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="directed"><nodes>'
    return _ordered([(0, _text(nodes, head)), (1, n), (2, _text(nodes, "</nodes><edges>")), (3, e), (4, _text(nodes, "</edges></graph></gexf>"))])


def cytoscape(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One element a line, as {"group": ..., "data": {...}}."""
    n = nodes.select(F.col("node").alias("k"), F.to_json(F.struct(F.lit("nodes").alias("group"), F.struct(F.col("node").cast("string").alias("id"), "label").alias("data"))).alias("value"))
    e = edges.select(F.concat_ws("\t", "src", "dst").alias("k"), F.to_json(F.struct(F.lit("edges").alias("group"), F.struct(F.concat_ws("->", "src", "dst").alias("id"), F.col("src").cast("string").alias("source"), F.col("dst").cast("string").alias("target"), "weight").alias("data"))).alias("value"))
    return _ordered([(0, n), (1, e)])
