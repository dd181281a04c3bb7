import pytest

from citeloom.operators import graph


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(1, 2), (1, 3), (2, 3), (3, 1), (4, 3), (5, 4)], "src long, dst long")


def test_degrees_and_pairs(edges):
    d = {r.node: (r.in_degree, r.out_degree) for r in graph.degrees(edges).collect()}
    assert d == {1: (1, 2), 2: (1, 1), 3: (3, 1), 4: (1, 1), 5: (0, 1)}
    assert {(r.a, r.b, r.weight) for r in graph.co_citation(edges).collect()} == {(2, 3, 1)}
    assert {(r.a, r.b, r.weight) for r in graph.coupling(edges).collect()} == {(1, 2, 1), (1, 4, 1), (2, 4, 1)}


def test_pagerank_sums_to_one(edges):
    r = {x.node: x["rank"] for x in graph.pagerank(edges, rounds=60).collect()}
    assert abs(sum(r.values()) - 1) < 1e-6 and max(r, key=r.get) == 3


def test_core_paths_and_levels(spark, edges):
    assert {r.node for r in graph.k_core(edges, 1).collect()} == {1, 2, 3}
    assert graph.shortest_path(edges, 5, 2) == [5, 4, 3, 1, 2]
    assert graph.shortest_path(edges, 2, 5) is None
    dag = spark.createDataFrame([(1, 2), (2, 3), (1, 3)], "src long, dst long")
    assert {(r.node, r.level) for r in graph.topological_levels(dag).collect()} == {(1, 0), (2, 1), (3, 2)}


def test_snowball_and_metrics(spark, edges):
    found = graph.snowball(edges, spark.createDataFrame([(3,)], "node long"), depth=2)
    assert {(r.node, r.depth, r.is_new) for r in found.where("depth = 1").collect()} == {(1, 1, True), (2, 1, True), (4, 1, True)}
    assert {r.node for r in found.where("is_new and depth = 2").collect()} == {5}
    m = graph.network_metrics(edges).first()
    assert (m.node_count, m.edge_count, m.density) == (5, 6, 0.3) and abs(m.avg_clustering - (1 + 1 + 1 / 3) / 5) < 1e-9
    h = {r.node: r for r in graph.hits(edges).collect()}
    assert max(h, key=lambda n: h[n].authority) == 3


def test_unknown_citing_work(spark, edges):
    nodes = spark.createDataFrame([(1,), (2,)], "node long")
    assert graph.record_citations(nodes, edges).count() == 3
    with pytest.raises(ValueError):
        graph.record_citations(nodes, edges, strict=True)
