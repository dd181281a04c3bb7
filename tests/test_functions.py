import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citeloom.functions import identifiers as idf
from citeloom.functions import records, text


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_identifiers(spark):
    doi = lambda s: idf.normalize_doi(F.lit(s))
    assert one(spark, doi(" https://doi.org/10.1234/ABC "), doi("doi:10.1234/abc"), doi("http://dx.doi.org/10.1/x"), idf.normalize_arxiv(F.lit("arXiv:2101.1"))) == ("10.1234/abc", "10.1234/abc", "10.1/x", "2101.1")
    assert one(spark, idf.parse_id(F.lit("doi:10.1/a:b")))[0].asDict() == {"ns": "doi", "value": "10.1/a:b"}
    assert one(spark, idf.parse_id(F.lit("nope:1")), idf.parse_id(F.lit("plain"))) == (None, None)
    ids = idf.id_set(idf.work_id("arxiv", F.lit("2101.1")), idf.work_id("internal", F.lit("7")), idf.work_id("doi", F.lit("10.1/A")))
    assert one(spark, idf.id_string(idf.primary(ids)), idf.ids_string(ids), idf.find_namespace(ids, "s2")) == ("doi:10.1/a", "arxiv:2101.1|internal:7|doi:10.1/a", None)
    only = idf.id_set(idf.work_id("internal", F.lit("7")))
    assert one(spark, idf.primary(only).isNull(), idf.overlap(ids, only)) == (True, True)
    assert one(spark, idf.valid_orcid(F.lit("0000-0001-2345-678X")), idf.valid_orcid(F.lit("0000")), idf.valid_language(F.lit("en-US")), idf.valid_language(F.lit("EN"))) == (True, False, True, False)


def test_titles(spark):
    n = lambda s: text.normalize_title(F.lit(s))
    assert one(spark, n("Héllo Wörld"), n("Deep Learning 🚀 and AI 🔥"), n("Deep &amp; Machine Learning"), n("pseudo-label"), n("日本")) == ("hello world", "deep learning and ai", "deep machine learning", "pseudolabel", "")
    r = lambda a, b: text.fuzzy_ratio(F.lit(a), F.lit(b))
    assert one(spark, r("same", "same"), r("a" * 10, "b" * 10), r("", "x"), r("kitten", "sitting")) == (100, 0, 0, 57)


@settings(max_examples=15, deadline=None)
@given(st.text(max_size=40))
def test_title_normal_form_is_stable(spark, s):
    df = spark.createDataFrame([(s,)], "t string").select(text.normalize_title(F.col("t")).alias("n"))
    once, twice = df.select("n", text.normalize_title(F.col("n"))).first()
    assert once == twice and (once is None or all(c.isdigit() or "a" <= c <= "z" or c == " " for c in once))


def test_strings(spark):
    assert one(spark, text.lucene_escape(F.lit("COVID-19 (Review): A state-of-the-art")))[0] == r"COVID\-19 \(Review\)\: A state\-of\-the\-art"
    assert one(spark, text.boolean_to_symbols(F.lit("a AND b  or c NOT d")))[0] == "a + b | c -d"
    assert one(spark, text.raw_url_encode(F.lit("a b*~")))[0] == "a%20b%2A~"
    p = one(spark, text.parse_author(F.lit("Doe, Jane")), text.parse_author(F.lit("Jane van Doe")), text.parse_author(F.lit("Plato")))
    assert [tuple(x) for x in p] == [("Doe", "Jane"), ("Doe", "Jane van"), ("Plato", None)]
    a = text.cache_key(F.lit("t"), F.lit(2000), F.lit(None), F.lit("en"), F.lit(1), F.lit(0), F.array(F.lit("b"), F.lit("a")))
    b = text.cache_key(F.lit("t"), F.lit(2000), F.lit(None), F.lit("en"), F.lit(1), F.lit(0), F.array(F.lit("a"), F.lit("b")))
    assert one(spark, a == b)[0]


def test_records(spark):
    t, f, null = F.lit(True), F.lit(False), F.lit(None).cast("int")
    assert one(spark, records.completeness(t, F.lit("a"), t, t, F.lit(2000), F.lit(1), f, t), records.completeness(f, F.lit(None), f, f, null, null, t, f)) == (10, 0)
    y = lambda a, b, c: records.year_in(F.lit(a), F.lit(b).cast("int"), F.lit(c).cast("int"))
    assert one(spark, y(2010, 2010, 2010), y(2009, 2010, None), y(2009, None, None)) == (True, False, True)
    o = lambda a, b, c, d: records.ranges_overlap(*[F.lit(x).cast("int") for x in (a, b, c, d)])
    assert one(spark, o(2000, 2005, 2005, 2010), o(2000, 2004, 2005, None), o(None, None, 1, 2)) == (True, False, True)


def test_references_and_letters_of_titles(spark):
    from citeloom.functions.text import normalize_title
    from citeloom.sources.projection import norm_sql

    titles = ["Caf&#233; &#xE9;t&#xe9; &#8211; na&#239;ve", "Stra&szlig;e Straße Æsop Œuvre Øre Łódź", "&#0; &#99999999; &#xD800; &#1114112; a&#", "A &amp;#233; &#38;amp; b", "&#196;rger &#x1F600; ok", None, ""]
    frame = spark.createDataFrame(list(enumerate(titles)), "k int, t string")
    ours = [r.n for r in frame.withColumn("n", normalize_title(F.col("t"))).orderBy("k").collect()]
    theirs = [duckdb.execute(f"select {norm_sql('$1::VARCHAR')}", [t]).fetchone()[0] for t in titles]
    assert ours[0] == "cafe ete naive"
    assert ours[1] == "stra e strasse aesop oeuvre ore lodz"
    assert ours == theirs
