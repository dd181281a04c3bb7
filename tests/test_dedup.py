import random

import pytest
from pyspark.sql import functions as F

from citeloom.functions.text import normalize_title
from citeloom.operators import dedup
from citeloom.operators.components import connected_components
from citeloom.operators.corpus import Corpus, identity_groups

SCHEMA = "seq long, title string, year int, ids array<struct<ns:string,value:string>>, abstract string, cited_by_count int, is_retracted boolean, source_provider string"


def works(spark, *rows):
    data = [(i, title, year, ids, abstract, cited, False, source) for i, (title, year, ids, abstract, cited, source) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA).withColumn("norm_title", normalize_title(F.col("title")))


def test_transitive_cluster_election_and_fusion(spark):
    w = works(
        spark,
        ("Alpha study", 2020, [("doi", "10.1/a")], None, 3, "doaj"),
        ("Beta study of something", 2020, [("doi", "10.1/a"), ("arxiv", "1")], "text", None, "openalex"),
        ("Gamma paper altogether", None, [("arxiv", "1")], None, 9, "arxiv"),
        ("Unrelated work", 2001, [("s2", "q")], None, None, "ieee"),
    )
    members = dedup.deduplicate(w)
    assert {(r.seq, r.cluster_id) for r in members.collect()} == {(0, 0), (1, 0), (2, 0), (3, 3)}
    assert {(r.cluster_id, r.representative, r.cluster_size) for r in dedup.elect(w, members).collect()} == {(0, 1, 3), (3, 3, 1)}
    fused = dedup.fuse_clusters(w, members).where("cluster_id = 0").first()
    assert (fused.title, fused.year, fused.abstract, fused.cited_by_count, fused.source_provider) == ("Beta study of something", 2020, "text", 9, "openalex")
    assert [tuple(x) for x in fused.ids] == [("doi", "10.1/a"), ("arxiv", "1")]
    assert dedup.summary(w, members).first().asDict() == {"input_count": 4, "unique_count": 2, "duplicates_removed": 2}


@pytest.mark.parametrize("a,b,ya,yb,found", [("Natural Language Processing", "Natural Language Procesing", 2020, 2020, 1), ("Same title here", "Same title here", 2018, 2020, 0), ("Same title here", "Same title here", None, 2020, 1), ("Machine Learning", "Computer Vision", 2020, 2020, 0), ("日本", "日本", 2020, 2020, 0)])
def test_fuzzy_pairs(spark, a, b, ya, yb, found):
    w = works(spark, (a, ya, [("s2", "1")], None, None, "arxiv"), (b, yb, [("s2", "2")], None, None, "arxiv"))
    pairs = dedup.title_fuzzy_policy(92)(w).collect()
    assert len(pairs) == found and all(p.confidence > 0.9 for p in pairs)


def test_neighbours_across_ranges(spark):
    w = works(spark, *[(f"title {i:03d}", 2000, [("s2", str(i))], None, None, "arxiv") for i in range(50)])
    assert {(r.a.seq, r.b.seq) for r in dedup.neighbours(w).collect()} == {(i, i + 1) for i in range(49)}


def test_policy_selection():
    assert list(dedup.select_policies(["fingerprint", "nope"])) == ["fingerprint"]
    assert list(dedup.select_policies([])) == list(dedup.POLICIES)


def test_components_match_a_union_find(spark):
    g = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(g.randrange(80), g.randrange(80)) for _ in range(50)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        ra, rb = sorted((find(a), find(b)))
        root[rb] = ra
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for e in edges for n in e}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_corpus_algebra(spark):
    c = Corpus(works(spark, ("a b", 2000, [("doi", "1")], None, 5, "arxiv"), ("c d", None, [("doi", "1"), ("s2", "x")], "t", None, "openalex"), ("e f", 2010, [("s2", "y")], None, 7, "ieee")))
    other = Corpus(c.df.where("seq = 1"))
    assert [r.seq for r in c.subtract(other).df.collect()] == [2]
    assert sorted(r.seq for r in c.contains(other).df.collect()) == [0, 1]
    assert [r.seq for r in c.sort_by_year().collect()] == [2, 0, 1]
    assert [r.seq for r in c.sort_by_citations().collect()] == [2, 0, 1]
    assert c.find_by_id("doi", "https://doi.org/1").first().seq == 0 and c.find_by_title(" E F ").first().seq == 2
    assert {(r.seq, r.group) for r in identity_groups(c.df).collect()} == {(0, 0), (1, 0), (2, 2)}
    merged = Corpus(c.df.where("seq < 2")).merge(Corpus(c.df.where("seq = 2"))).df.orderBy("seq").collect()
    assert [(r.seq, r.title, r.abstract, r.cited_by_count) for r in merged] == [(0, "a b", "t", 5), (2, "e f", None, 7)]
