import json

import pytest
from pyspark.sql import functions as F

from citeloom.plans import search
from citeloom.sources import export, fetch, payloads
from citeloom.sources.store import ProjectLocked, ResultCache, Store

OPENALEX = {"results": [{"id": "https://openalex.org/W1", "ids": {"openalex": "https://openalex.org/W1", "doi": "https://doi.org/10.1/A", "pmid": None}, "display_name": "A Title", "publication_year": 2021, "cited_by_count": 4, "is_retracted": False, "primary_location": {"source": {"display_name": "J", "issn_l": "1234-5678", "type": "journal"}}, "authorships": [{"author": {"display_name": "Jane van Doe", "orcid": "https://orcid.org/0000-0001-2345-6789"}}], "abstract_inverted_index": {"world": [1], "hello": [0, 2]}}]}
CROSSREF = {"message": {"items": [{"DOI": "10.1/a", "title": ["A title"], "author": [{"given": "J.", "family": "Doe"}, {"given": "X"}], "published-print": {"date-parts": [[2020, 5]]}, "container-title": ["K"], "type": "proceedings-article", "is-referenced-by-count": 9}, {"DOI": "10.1/none", "title": []}]}}
ARXIV = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/2101.00001v2</id><title>Some\n   title</title><summary> s </summary><published>2021-01-02T00:00:00Z</published><author><name>Ann Bee</name></author></entry></feed>'
PUBMED = '<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>77</PMID><Article><ArticleTitle>Sparse</ArticleTitle><Journal><Title>T</Title><JournalIssue><PubDate><MedlineDate>1999 Jan-Feb</MedlineDate></PubDate></JournalIssue></Journal></Article></MedlineCitation></PubmedArticle></PubmedArticleSet>'


@pytest.fixture
def frames(spark, tmp_path):
    for name, body in (("openalex", json.dumps(OPENALEX)), ("crossref", json.dumps(CROSSREF)), ("arxiv", ARXIV), ("pubmed", PUBMED)):
        (tmp_path / f"{name}.dat").write_text(body)
    return {s: payloads.normalize(payloads.scan(spark, s, str(tmp_path / f"{s}.dat")), s) for s in ("openalex", "crossref", "arxiv", "pubmed")}


def test_normalizers(frames):
    o = frames["openalex"].first()
    assert (o.title, o.abstract, o.year, o.venue.issn) == ("A Title", "hello world hello", 2021, "1234-5678")
    assert [tuple(x) for x in o.ids] == [("doi", "10.1/a"), ("openalex", "https://openalex.org/w1")]
    assert (o.authors[0].given, o.authors[0].family, o.authors[0].orcid) == ("Jane", "van Doe", "0000-0001-2345-6789")
    c = frames["crossref"].collect()
    assert len(c) == 1 and (c[0].year, c[0].venue.type, len(c[0].authors)) == (2020, "conference", 1)
    a = frames["arxiv"].first()
    assert (a.title, a.year, a.ids[0].value, a.authors[0].family, a.venue.type) == ("Some title", 2021, "2101.00001", "Bee", "repository")
    p = frames["pubmed"].first()
    assert (p.year, p.abstract, p.authors, p.ids[0].value) == (1999, None, [], "77")


def test_federated_search(spark, frames, tmp_path):
    cache = ResultCache(spark, str(tmp_path / "cache"))
    got = search.aggregate(frames, failed={"ieee": "no key"}, cache=cache, key="k")
    assert got.total_raw == 4 and got.records.count() == 3 and not got.from_cache
    assert {(r.source_provider, r.result_count, r.skip_reason) for r in got.stats.collect()} >= {("openalex", 1, None), ("ieee", 0, "no key")}
    fused = got.records.where(F.exists("ids", lambda x: x["ns"] == "doi")).first()
    assert (fused.source_provider, fused.cited_by_count, fused.abstract) == ("openalex", 9, "hello world hello")
    assert search.aggregate(frames, cache=cache, key="k").from_cache
    cache.invalidate_all()
    assert cache.get("k") is None
    assert payloads.fetch_by_id(frames, "doi", "10.1/A").first().source_provider == "crossref"


def test_exports(spark, frames):
    w = search.with_seq(frames["openalex"])
    bib = export.bibtex(w).first().value
    assert bib.startswith("@article{doi_10_1_a,") and "title = {A Title}" in bib
    assert "AU  - van Doe, Jane" in export.ris(w).first().value and export.ris(w).first().value.endswith("ER  - ")
    assert json.loads(export.json_lines(w).first().value)["title"] == "A Title" and export.flat(w).first().authors == "van Doe, Jane"
    nodes = spark.createDataFrame([(1, "a & b"), (2, "c")], "node long, label string")
    edges = spark.createDataFrame([(1, 2, 1.0)], "src long, dst long, weight double")
    import xml.etree.ElementTree as ET

    for kind in (export.graphml, export.gexf):
        root = ET.fromstring("\n".join(r.value for r in kind(nodes, edges).collect()).encode())
        assert len(root.findall(".//{*}node")) == 2 and len(root.findall(".//{*}edge")) == 1
    assert [json.loads(r.value)["group"] for r in export.cytoscape(nodes, edges).collect()] == ["nodes", "nodes", "edges"]


def test_store(spark, tmp_path, frames):
    s = Store(spark, str(tmp_path / "db"))
    s.save_works(frames["openalex"])
    s.save_works(frames["openalex"].withColumn("title", F.lit("New")))
    ids = spark.createDataFrame([("doi:10.1/a",), ("doi:missing",)], "id string")
    found = s.find_works(ids).collect()
    assert len(found) == 1 and found[0].title == "New" and [a.author_name for a in found[0].authors] == ["van Doe, Jane"]
    assert s.read("work_external_ids").where("is_primary").count() == 1
    clusters = spark.createDataFrame([("c", "p", "doi", "doi:10.1/a", 1.0, False)], "id string, project_id string, strategy string, representative string, confidence double, is_locked boolean")
    members = spark.createDataFrame([("c", "doi:10.1/a", True, "doi_match", 1.0), ("c", "w2", False, "doi_match", 1.0)], "cluster_id string, work_id string, is_representative boolean, reason string, confidence double")
    s.save_clusters(clusters, members)
    s.save_clusters(clusters, members.limit(1))
    assert s.project_clusters("p").first().cluster_size == 1
    s.lock_project("p")
    with pytest.raises(ProjectLocked):
        s.save_clusters(clusters, members)
    with pytest.raises(ProjectLocked):
        s.guard_unlocked("p")
    links = spark.createDataFrame([("q", "w", "arxiv", 1), ("q", "w", "arxiv", 2)], "query_id string, work_id string, provider string, place int")
    s.link_works(links)
    s.link_works(links.withColumn("place", F.lit(9)))
    assert s.read("query_works").count() == 1
    s.save_graph(spark.createDataFrame([("g", "p", "n", "citation")], "id string, project_id string, name string, graph_type string"), spark.createDataFrame([("g", "doi:10.1/a", "doi:10.1/a", 1.0), ("g", "doi:10.1/a", "gone", 1.0)], "graph_id string, src string, dst string, weight double"))
    assert s.load_graph("g")[1].count() == 1
    s.delete_works(ids)
    assert s.read("works").count() == 0 and s.read("work_authors").count() == 0 and s.read("clusters").first().representative is None
    s.delete_graph("g")
    assert s.read("citation_edges").count() == 0


def test_limits_retries_and_paging():
    now, slept = [0.0], []
    sleep = lambda t: (slept.append(t), now.__setitem__(0, now[0] + t))
    bucket = fetch.TokenBucket(2, clock=lambda: now[0], sleep=sleep)
    assert bucket.try_consume() and bucket.try_consume() and not bucket.try_consume()
    bucket.wait()
    assert abs(sum(slept) - 0.5) < 0.01
    answers = iter([(503, ""), (429, ""), (200, "ok")])
    assert fetch.with_retries(lambda: next(answers), sleep=lambda t: None) == "ok"
    with pytest.raises(fetch.SourceUnavailable):
        fetch.with_retries(lambda: (404, ""), sleep=lambda t: None)
    q = fetch.SearchQuery("graph mining", 2020, 2021, max_results=2000)
    pages = iter([(200, '{"token": "t"}'), (404, "")])
    assert len(list(fetch.read_pages("semantic_scholar", q, lambda s, r: next(pages), sleep=lambda t: None))) == 1
    assert next(fetch.requests("openalex", q))["filter"] == "publication_year:2020-2021"
    with pytest.raises(fetch.SourceUnavailable):
        list(fetch.requests("ieee", q))
    for bad in ({"term": "x"}, {"term": "ok", "year_from": 2021, "year_to": 2020}, {"term": "ok", "year_from": 10}):
        with pytest.raises(ValueError):
            fetch.SearchQuery(**bad)
    assert q.is_first_page() and q.next_page().offset == 2000


def test_batch_file():
    text = 'project: "p"\nqueries:\n  - id: Q1\n    text: "one two"\n    year_min: 2020\n    metadata:\n      theme: a\n      priority: high\n  - id: Q2\n    text: three\n    max_results: 5\n'
    batch = fetch.query_batch(text)
    assert [i for i, _ in batch] == ["Q1", "Q2"] and batch[0][1].year_from == 2020 and batch[1][1].max_results == 5
    assert [i for i, _ in fetch.query_batch(text, priority="high")] == ["Q1"] and [i for i, _ in fetch.query_batch(text, only=["Q2"])] == ["Q2"]


def test_search_data_source(spark):
    def recorded(source, request):
        return 200, json.dumps({"source": source, "term": request.get("query")})

    class Recorded(fetch.SearchSource):
        transport = staticmethod(recorded)

    spark.dataSource.register(Recorded)
    df = spark.read.format("citeloom_search").option("query", json.dumps({"term": "graph", "max_results": 10})).option("sources", "crossref,ieee").load()
    rows = {r.source: r for r in df.collect()}
    assert json.loads(rows["crossref"].body)["term"] == "graph" and rows["ieee"].error == "no key"


def test_streams(spark, tmp_path, frames):
    from citeloom.streaming import incremental

    landing = str(tmp_path / "landing")
    frames["openalex"].write.parquet(landing)
    store = Store(spark, str(tmp_path / "streamed"))
    stream = spark.readStream.schema(frames["openalex"].schema).parquet(landing)
    incremental.resolve_new(stream, store, str(tmp_path / "ck")).awaitTermination()
    assert store.read("works").count() == 1
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert incremental.event_counts(events).agg(F.sum("n")).first()[0] == events.count()
    assert incremental.run_sessions(events).agg(F.sum("n")).first()[0] == events.count()


def test_terms_are_sent_in_each_sources_syntax():
    q = fetch.SearchQuery("COVID-19 (Review): A AND b NOT c", 2020, 2024)
    assert next(fetch.requests("doaj", q))["term"] == "COVID\\-19 \\(Review\\)\\: A AND b NOT c AND bibjson.year:[2020 TO 2024]"
    assert next(fetch.requests("semantic_scholar", q))["query"] == "COVID-19 (Review): A + b -c"


@pytest.mark.parametrize("history", [True, False])
def test_pubmed_searches_then_fetches(history):
    asked = []

    def transport(source, request):
        asked.append(request)
        if request["step"] == "search":
            found = {"count": "450", "idlist": [str(i) for i in range(450)]} | ({"querykey": "1", "webenv": "w"} if history else {})
            return 200, json.dumps({"esearchresult": found})
        return (404, "") if request["retstart"] == 200 else (200, f"<{request['retstart']}>")

    q = fetch.SearchQuery("term one", 2020, None, max_results=410)
    assert list(fetch.read_pages("pubmed", q, transport, sleep=lambda s: None)) == ["<0>", "<400>"]
    assert asked[0]["term"] == "(term one) AND 2020:3000[Date - Publication]"
    fetched = [a for a in asked if a["step"] == "fetch"]
    assert sorted({a["retstart"] for a in fetched}) == [0, 200, 400] and fetched[-1]["retmax"] == 10
    assert all(("WebEnv" in a) == history and ("id" in a) != history for a in fetched)
    assert list(fetch.read_pages("pubmed", q, lambda s, r: (200, json.dumps({"esearchresult": {"count": "0"}})), sleep=lambda s: None)) == []


@pytest.mark.parametrize("history", [True, False])
def test_pubmed_goes_on_from_an_offset(history):
    def transport(source, request):
        if request["step"] == "search":
            assert (request["retstart"], request["retmax"]) == (300, 250)
            return 200, json.dumps({"esearchresult": {"count": "500", "idlist": [str(i) for i in range(300, 500)]} | ({"querykey": "1", "webenv": "w"} if history else {})})
        return 200, f"{request['retstart']}+{request['retmax']}" if history else request["id"].split(",")[0]

    got = list(fetch.read_pages("pubmed", fetch.SearchQuery("term", max_results=250, offset=300), transport, sleep=lambda s: None))
    assert got == (["300+200"] if history else ["300"])


def test_two_writers_of_one_version(spark, tmp_path):
    from citeloom.sources.store import ChangedMeanwhile, Store

    store = Store(spark, f"file://{tmp_path}")
    row = spark.createDataFrame([("p", "name")], "id string, name string")
    store.upsert("projects", row)
    (tmp_path / "projects" / "claim-v2").touch()  # another writer has begun
    with pytest.raises(ChangedMeanwhile):
        store.upsert("projects", row.withColumn("name", F.lit("other")))
    assert store.read("projects").first().name == "name"
    store.release("projects")
    store.upsert("projects", row.withColumn("name", F.lit("other")))
    assert store.read("projects").first().name == "other" and not list((tmp_path / "projects").glob("claim*"))


def test_the_first_of_equal_keys_is_kept(spark, tmp_path):
    from citeloom.sources.store import Store

    store = Store(spark, f"file://{tmp_path}")
    rows = spark.range(0, 200).selectExpr("id % 5 as decision_id", "cast(id as string) as project").coalesce(1)
    store.insert_new("screening_decisions", rows)
    store.insert_new("screening_decisions", rows.withColumn("project", F.lit("later")))
    assert {(r.decision_id, r.project) for r in store.read("screening_decisions").collect()} == {(k, str(k)) for k in range(5)}


def test_fetched_pages_become_one_result(spark):
    rows = [
        ("crossref", 0, json.dumps({"message": {"items": [{"DOI": "10.1/A", "title": ["A paper"]}, {"DOI": "10.1/b", "title": ["Another"]}]}}), None, 12),
        ("arxiv", 0, "<feed><entry><id>http://arxiv.org/abs/2101.00001v1</id><title>A third one</title></entry></feed>", None, 30),
        ("ieee", -1, None, "no key", 4),
    ]
    got = search.federated(spark.createDataFrame(rows, "source string, page int, body string, error string, latency_ms long"))
    assert {r.title for r in got.records.collect()} == {"A paper", "Another", "A third one"}
    assert sorted((r.source_provider, r.result_count, r.skip_reason, r.latency_ms) for r in got.stats.collect()) == [("arxiv", 1, None, 30), ("crossref", 2, None, 12), ("ieee", 0, "no key", 4)]


def test_places_are_unique_beyond_any_number_of_partitions(spark):
    df = spark.range(0, 5000, 1, 2500).select(F.col("id").alias("n"), F.lit(1).alias("source_rank"))
    got = search.with_seq(df)
    assert got.select("seq").distinct().count() == 5000
    assert [r.n for r in got.orderBy("seq").collect()] == list(range(5000))


def test_the_last_record_of_an_id_is_saved(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    kind = "ids array<struct<ns:string,value:string>>, title string, authors array<struct<family:string,given:string,orcid:string,normalized:string>>, retrieved_at timestamp"
    import datetime

    day = lambda d: datetime.datetime(2024, 1, d)
    rows = [([("doi", "10.1/a")], "first", [("One", "A", None, "one a")], day(1)), ([("doi", "10.1/a"), ("arxiv", "2101.1")], "second", [("Two", "B", None, "two b"), ("Three", "C", None, "three c")], day(2)), ([("doi", "10.1/b")], "other", [], day(1))]
    s.save_works(spark.createDataFrame(rows, kind).coalesce(1))
    works = {r.title for r in s.read("works").collect()}
    assert works == {"second", "other"}
    assert sorted((r.namespace, r.value, r.is_primary) for r in s.read("work_external_ids").collect() if r.value != "10.1/b") == [("arxiv", "2101.1", False), ("doi", "10.1/a", True)]
    assert sorted((r.position, r.author_name) for r in s.read("work_authors").collect()) == [(0, "Two, B"), (1, "Three, C")]


def test_routing_by_identifier_follows_what_a_source_supports(spark):
    rows = {s: payloads.normalize(payloads.items_of(spark.createDataFrame([(b,)], "body string"), s), s) for s, b in (("arxiv", "<feed><entry><id>http://arxiv.org/abs/2101.00001v1</id><title>T</title><doi>10.1/x</doi></entry></feed>"), ("crossref", json.dumps({"message": {"items": [{"DOI": "10.1/y", "title": ["U"]}]}})))}
    assert payloads.fetch_by_id(rows, "arxiv", "2101.00001").first().source_provider == "arxiv"
    assert payloads.fetch_by_id(rows, "doi", "10.1/y").first().source_provider == "crossref"
    assert payloads.fetch_by_id(rows, "doi", "10.1/x").count() == 0
