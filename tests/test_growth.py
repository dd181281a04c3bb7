"""Work that grows with the input and no faster: long texts, hot keys, large graphs."""

import time

from pyspark.sql import functions as F

from citeloom.plans import interchange
from citeloom.sources import payloads


def test_an_inverted_index_of_a_long_text_takes_linear_time(spark):
    words = [f"w{k % 700}" for k in range(3000)]
    df = spark.createDataFrame([(" ".join(words),), ("b a b",), ("",), (None,)], "title string")
    began = time.time()
    index = df.select("title", interchange.index_of_words(F.split("title", " ")).alias("index"))
    got = {r.title: (r["index"], r.text) for r in index.select("title", "index", payloads.abstract_of_index(F.col("index")).alias("text")).collect()}
    assert time.time() - began < 30
    assert got[" ".join(words)][1] == " ".join(words) and got[" ".join(words)][0]["w3"] == [3, 703, 1403, 2103, 2803]
    assert got["b a b"] == ({"a": [1], "b": [0, 2]}, "b a b") and got[""] == ({"": [0]}, None) and got[None] == (None, None)


def test_two_words_on_one_place_and_gaps(spark):
    df = spark.createDataFrame([({"a": [0, 5], "c": [5], "b": [5, 9]},)], "i map<string,array<int>>")
    assert df.select(payloads.abstract_of_index(F.col("i"))).first()[0] == "a c b"


def test_the_first_of_each_source_are_not_brought_together(spark):
    from citeloom.plans import search

    of = lambda source, start, end: spark.range(start, end, 1, 4).select(F.lit(source).alias("source_provider"), "id")
    df = of("b", 0, 150).union(of("a", 150, 200))
    raw = search.with_seq(df)
    plan = search.first_of_each(raw, 1 << 40)
    under = plan.selectExpr("id + 1 as id")._jdf.queryExecution().executedPlan().toString()
    # what is put in order is the counts, which do not have the rows' own columns
    assert plan.count() == 200 and "Window" in under and not any("id#" in line for line in under.split("\n") if "Exchange hashpartitioning" in line)
    assert all(" Sort " not in line or "_part#" in line for line in under.split("\n"))
    for n in (0, 1, 31, 170):
        got = sorted((r.source_provider, r.id) for r in search.first_of_each(raw, n).collect())
        assert got == [("a", k) for k in range(150, 150 + min(n, 50))] + [("b", k) for k in range(min(n, 150))]


def test_a_name_that_most_rows_hold_is_not_one_tasks(spark):
    from citeloom.operators import corpus

    authors = spark.range(6000).selectExpr("id", "if(id % 100 = 7, concat('n', id), if(id = 5, null, 'same')) as normalized", "cast(null as string) as orcid")
    other = spark.createDataFrame([("same", None), ("n107", None), (None, None)], "normalized string, orcid string")
    want = {k for k in range(6000) if k % 100 != 7 and k != 5} | {107}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for of in (corpus.shared_authors, corpus.shared_persons):
            found = of(authors, other)
            assert {r.id for r in found.collect()} == want
            assert max(found.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()) < 4000, "all rows of a name came to one task"
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_persons_by_orcid_or_name(spark):
    from itertools import product

    from citeloom.operators import corpus

    both = [(o, n) for o, n in product(("1", "2", None), ("a", "b", "c", None))]
    authors = spark.createDataFrame([(k, o, n) for k, (o, n) in enumerate(both + both)], "id long, orcid string, normalized string")
    theirs = [("1", "x"), (None, "a"), ("3", "b"), (None, None)]
    want = [k for k, (o, n) in enumerate(both + both) if any((o is not None and o == p) or (n is not None and n == m and (o is None or p is None)) for p, m in theirs)]
    assert sorted(r.id for r in corpus.shared_persons(authors, spark.createDataFrame(theirs, "orcid string, normalized string")).collect()) == want


def test_levels_that_hold_most_pairs_do_not_send(spark, monkeypatch):
    import random

    from test_network import plain_betweenness, table

    from citeloom.operators import centrality

    rng = random.Random(3)
    edges = {(a, b) for a, b in ((rng.randrange(120), rng.randrange(120)) for _ in range(900)) if a != b} | {(0, 200), (200, 201), (201, 202)}
    made, real = [], centrality.stash
    monkeypatch.setattr(centrality, "stash", lambda df, name: made.append((name, str(df._jdf.queryExecution().optimizedPlan()))) or real(df, name))
    got = {r.node: r.betweenness for r in centrality.betweenness(table(spark, edges), spark.createDataFrame([(0,), (1,), (2,)], "node long")).collect()}
    want = plain_betweenness(edges, (0, 1, 2))
    assert got.keys() == {x for e in edges for x in e} and all(abs(got[v] - want[v]) < 1e-9 for v in got)
    assert any(name == "rest" for name, _ in made), "pairs reached last sent along all their edges"


def test_a_round_of_hits_exchanges_messages_alone(spark, monkeypatch):
    from test_network import random_edges, table

    from citeloom.operators import graph

    plans, real = [], graph.stash_bucketed

    def seen(df, name, *keys, **more):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return real(df, name, *keys, **more)

    monkeypatch.setattr(graph, "stash_bucketed", seen)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        graph.hits(table(spark, random_edges(2, 30, 120)), rounds=1)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    rounds = [plan for name, plan in plans if name in ("hits_a", "hits_h")]
    assert len(rounds) == 2 and all(plan.count("Exchange") == 1 and "SortMergeJoin" not in plan for plan in rounds)


def test_triangles_are_found_by_a_row_an_edge(spark):
    from itertools import combinations

    from test_network import random_edges, table

    from citeloom.operators import graph

    edges = random_edges(6, 40, 300) | {(100, k) for k in range(40)}
    und = {frozenset(e) for e in edges}
    want = {}
    for three in combinations({v for e in edges for v in e}, 3):
        if all(frozenset(p) in und for p in combinations(three, 2)):
            for v in three:
                want[v] = want.get(v, 0) + 1
    found = graph.triangles(table(spark, edges))
    assert {r.node: r.triangles for r in found.collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "posexplode" in plan, "a row for each pair of a node's ends"


def test_rounds_of_the_citation_order_send_nothing_to_the_driver(spark, monkeypatch):
    from test_network import table

    from citeloom.operators import forests, graph

    plans = []
    for module in (forests, graph):
        for make in ("stash", "stash_bucketed"):
            real = getattr(module, make, None)
            if real is not None:
                monkeypatch.setattr(module, make, lambda df, name, *keys, _real=real, **more: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or _real(df, name, *keys, **more))
    edges = {(1, 2), (2, 1), (2, 3), (3, 4), (4, 3), (4, 6), (5, 5), (3, 3), (6, 6)}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {r.node: (r.scc, r.level) for r in forests.citation_order(table(spark, edges)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert got == {1: (1, 0), 2: (1, 0), 3: (3, 1), 4: (3, 1), 5: (5, 0), 6: (6, 2)}
    rounds = [(name, plan) for name, plan in plans if name != "order"]
    assert len(rounds) > 10 and not [name for name, plan in rounds if "BroadcastExchange" in plan]
