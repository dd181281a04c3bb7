"""Graph operators against plain versions, with hubs, circles and ties."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest

from citeloom.operators import centrality, forests, graph, pairs
from citeloom.plans import network, registry


def table(spark, edges):
    return spark.createDataFrame(sorted(edges), "src long, dst long")


@pytest.fixture(scope="module")
def hubby():
    """Two works that cite nearly everything, and works with short lists."""
    rng = random.Random(4)
    edges = {(1000, k) for k in range(60)} | {(1001, k) for k in range(5, 70)}
    edges |= {(2000 + s, rng.randrange(70)) for s in range(60) for _ in range(5)}
    return edges


def weights(edges):
    refs = defaultdict(set)
    for s, d in edges:
        refs[s].add(d)
    return Counter(p for r in refs.values() for p in combinations(sorted(r), 2))


@pytest.mark.parametrize("block", [7, 2048])
@pytest.mark.parametrize("least", [1, 2, 3])
def test_pairs_of_hubs(spark, hubby, monkeypatch, block, least):
    monkeypatch.setattr(pairs, "BLOCK", block)
    got = {(r.a, r.b): r.weight for r in graph.co_citation(table(spark, hubby), least).collect()}
    assert got == {p: w for p, w in weights(hubby).items() if w >= least}


@pytest.mark.parametrize("thresholds", [(4, 3), ()])
def test_strongest_partners_with_early_stop(spark, hubby, monkeypatch, thresholds):
    monkeypatch.setattr(pairs, "BLOCK", 9)
    both = defaultdict(list)
    for (a, b), w in weights(hubby).items():
        both[a].append((-w, b))
        both[b].append((-w, a))
    want = {(a, k, b, -w) for a, found in both.items() for k, (w, b) in enumerate(sorted(found)[:3], 1)}
    got = pairs.strongest(table(spark, hubby), "src", "dst", 3, thresholds)
    assert {(r.node, r["rank"], r.other, r.weight) for r in got.collect()} == want


@pytest.mark.parametrize("block", [7, 2048])
def test_pairs_of_hot_items_are_dealt_over_tasks(spark, hubby, monkeypatch, block):
    monkeypatch.setattr(pairs, "BLOCK", block)
    monkeypatch.setattr(pairs, "PAIRS_A_TASK", 150)
    monkeypatch.setattr(pairs, "HUBS", 40)
    counted = pairs._counted(table(spark, hubby).selectExpr("src as key", "dst as item"))
    assert {(r.a, r.b): r.weight for r in counted.collect()} == weights(hubby)
    assert counted.rdd.getNumPartitions() >= sum(weights(hubby).values()) // 150, "tasks do not grow with the pairs"


def test_strongest_partners_without_hubs_are_counted_at_once(spark, hubby):
    both = defaultdict(list)
    for (a, b), w in weights(hubby).items():
        both[a].append((-w, b))
        both[b].append((-w, a))
    want = {(a, k, b, -w) for a, found in both.items() for k, (w, b) in enumerate(sorted(found)[:3], 1)}
    found = pairs.strongest(table(spark, hubby), "src", "dst", 3)
    assert {(r.node, r["rank"], r.other, r.weight) for r in found.collect()} == want


@pytest.mark.parametrize("block", [7, 2048])
def test_the_backbone_is_small_and_has_the_whole_forest(spark, monkeypatch, block):
    monkeypatch.setattr(pairs, "BLOCK", block)
    edges = {(s, d) for s, d in random_edges(8, 60, 400)} | {(99, d) for d in range(40)}
    every = {(a, b, w) for (a, b), w in weights(edges).items()}
    some = graph.co_citation_backbone(table(spark, edges))
    rows = {(r.a, r.b, r.weight) for r in some.collect()}
    assert rows < every
    got = {(r.a, r.b, r.weight) for r in forests.spanning_forest(some, largest=True, simple=True).collect()}
    assert got == kruskal(every, -1)


def random_edges(seed, n, m):
    rng = random.Random(seed)
    return {(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if a != b}


def plain_betweenness(edges, sources):
    out, back = defaultdict(list), defaultdict(float)
    for s, d in edges:
        out[s].append(d)
    for s in sources:
        depth, paths, order = {s: 0}, Counter({s: 1}), [s]
        for v in order:
            for w in out[v]:
                if w not in depth:
                    depth[w] = depth[v] + 1
                    order.append(w)
                if depth[w] == depth[v] + 1:
                    paths[w] += paths[v]
        share = Counter()
        for v in reversed(order):
            share[v] = sum(paths[v] / paths[w] * (1 + share[w]) for w in out[v] if depth[w] == depth[v] + 1)
            if v != s:
                back[v] += share[v]
    return back


def test_betweenness_of_all_sources(spark):
    edges = random_edges(1, 40, 90)
    nodes = {x for e in edges for x in e}
    want = plain_betweenness(edges, nodes)
    got = {r.node: r.betweenness for r in centrality.betweenness(table(spark, edges), graph.nodes_of(table(spark, edges))).collect()}
    assert got.keys() == nodes
    assert all(abs(got[v] - want[v]) < 1e-9 for v in nodes)


def test_betweenness_of_unknown_and_repeated_sources(spark):
    edges = {(1, 2), (2, 3), (3, 4)}
    got = centrality.betweenness(table(spark, edges), spark.createDataFrame([(1,), (1,), (99,)], "node long")).collect()
    assert {r.node: r.betweenness for r in got} == {1: 0.0, 2: 2.0, 3: 1.0, 4: 0.0}


def kruskal(edges, sign):
    root, out = {}, set()

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for w, a, b in sorted((sign * w, a, b) for a, b, w in edges):
        if find(a) != find(b):
            root[find(a)] = find(b)
            out.add((a, b, sign * w))
    return out


@pytest.mark.parametrize("largest", [False, True])
def test_spanning_forest_is_that_of_kruskal(spark, largest):
    rng = random.Random(7)
    ends = {tuple(sorted(e)) for e in random_edges(3, 60, 70) | {(100, 101), (101, 102), (100, 102)}}
    edges = [(a, b, rng.randrange(5)) for a, b in sorted(ends)]
    df = spark.createDataFrame([*edges, (5, 5, 1), *((b, a, w) for a, b, w in edges[:9])], "a long, b long, weight long")
    got = {(r.a, r.b, r.weight) for r in forests.spanning_forest(df, largest).collect()}
    assert got == kruskal(edges, -1 if largest else 1)


def test_spanning_forest_of_nothing(spark):
    assert forests.spanning_forest(spark.createDataFrame([], "a long, b long, weight long")).collect() == []


def reach(edges):
    out = defaultdict(set)
    for s, d in edges:
        out[s].add(d)
    found = {}
    for v in {x for e in edges for x in e}:
        seen, stack = {v}, [v]
        while stack:
            for w in out[stack.pop()] - seen:
                seen.add(w)
                stack.append(w)
        found[v] = seen
    return found


@pytest.mark.parametrize("edges", [random_edges(11, 50, 70), {(3, 2), (2, 1), (1, 0)}, {(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 1)}])
def test_strong_components_and_levels(spark, edges):
    far = reach(edges)
    scc = {v: min(w for w in far[v] if v in far[w]) for v in far}
    got = {r.node: r for r in forests.citation_order(table(spark, edges)).collect()}
    assert {v: r.scc for v, r in got.items()} == scc

    def level(part):
        return max((1 + level(scc[s]) for s, d in edges if scc[d] == part and scc[s] != part), default=0)

    assert {v: r.level for v, r in got.items()} == {v: level(scc[v]) for v in far}


def test_core_numbers_are_those_of_peeling(spark):
    edges = random_edges(5, 40, 220)
    nodes = {x for e in edges for x in e}
    want = dict.fromkeys(nodes, 0)
    for k in range(1, 40):
        left = set(nodes)
        while True:
            gone = {v for v in left if sum(s in left for s, d in edges if d == v) < k}
            if not gone:
                break
            left -= gone
        want.update(dict.fromkeys(left, k))
    assert {r.node: r.core for r in graph.core_numbers(table(spark, edges)).collect()} == want
    assert {r.node for r in graph.k_core(table(spark, edges), 4).collect()} == {v for v, k in want.items() if k >= 4}


def test_analysis_holds_what_the_single_measures_say(spark):
    edges = table(spark, random_edges(9, 30, 120))
    got = {r.node: r for r in graph.analyze(edges).collect()}
    ranks = {r.node: r["rank"] for r in graph.pagerank(edges).collect()}
    cores = {r.node: r.core for r in graph.core_numbers(edges).collect()}
    local = {r.node: r.clustering for r in graph.local_clustering(edges).collect()}
    ends = {r.node: (r.in_degree, r.out_degree) for r in graph.degrees(edges).collect()}
    assert got.keys() == ranks.keys()
    assert all(abs(got[v]["rank"] - ranks[v]) < 1e-6 and (got[v].core, got[v].clustering, (got[v].in_degree, got[v].out_degree)) == (cores[v], local[v], ends[v]) for v in got)


def test_a_round_exchanges_messages_alone(spark):
    """Edges and state lie in buckets: the plan of a round's join and sum has one exchange, that of the sums by target."""
    layout = graph.EdgeLayout(table(spark, random_edges(2, 30, 120)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        shares = layout.nodes.selectExpr("node as src", "1.0D / out_degree as share")
        sent = layout.by_src.join(shares, "src").groupBy("dst").sum("share").withColumnRenamed("dst", "node")
        plan = layout.nodes.join(sent, "node", "left")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
        layout.drop()
    assert plan.count("Exchange hashpartitioning") == 1, plan


def test_settled_nodes_are_not_read_again(spark, monkeypatch):
    """A long tail: works of a dense block settle at once, a chain falls one by one; a round reads short works alone."""
    chain = {(k, k + 1) for k in range(100, 112)}
    edges = {(a, b) for a in range(8) for b in range(8) if a != b} | chain
    read, real = [], graph.stash

    def counted(df, name):
        out = real(df, name)
        if name == "cores-changed":
            read.append(out.count())
        return out

    monkeypatch.setattr(graph, "stash", counted)
    got = {r.node: r.core for r in graph.core_numbers(table(spark, edges)).collect()}
    assert got == {v: 7 if v < 8 else 0 for e in edges for v in e}
    assert len(read) > 5 and max(read[1:]) <= 2


def rounds_of_cores(edges, rounds):
    """Every node at once takes the largest h such that h of its citing works have h or more, ``rounds`` times."""
    core = {v: sum(d == v for _, d in edges) for e in edges for v in e}
    for _ in range(rounds):
        core = {v: min(core[v], max((min(k + 1, c) for k, c in enumerate(sorted((core[s] for s, d in edges if d == v), reverse=True))), default=0)) for v in core}
    return core


@pytest.mark.parametrize("rounds", [1, 2, 3, 6])
def test_core_numbers_after_so_many_rounds(spark, rounds):
    edges = random_edges(5, 40, 160) | {(k, k + 1) for k in range(100, 110)}
    assert rounds_of_cores(edges, rounds) != rounds_of_cores(edges, 20)
    assert {r.node: r.core for r in graph.core_numbers(table(spark, edges), rounds=rounds).collect()} == rounds_of_cores(edges, rounds)


@pytest.fixture(scope="module")
def long_tail(tmp_path_factory):
    """Works that cite one another in a row of 40: their core numbers have not settled when the SQL's rounds are over."""
    import duckdb

    d, c = str(tmp_path_factory.mktemp("long-tail")), duckdb.connect()
    c.execute(f"COPY (SELECT range AS p_partkey FROM range(60)) TO '{d}/part.parquet'")
    c.execute(f"COPY (SELECT range AS l_orderkey, range + 1 AS l_partkey FROM range(40) UNION ALL SELECT a.range, b.range FROM range(50, 55) a, range(50, 55) b) TO '{d}/lineitem.parquet'")
    for t in ("part", "lineitem"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return d, c


def test_core_numbers_query_gives_its_sqls_rows_on_a_long_tail(spark, long_tail):
    d, c = long_tail
    got = sorted(tuple(r) for r in network.core_numbers(spark, d).collect())
    assert got == sorted(c.execute(registry.oracle_sql()["core_numbers"]).fetchall())
    assert dict(got)[40] == 1 and dict(got)[20] == 0


def test_network_analysis_gives_its_sqls_rows_on_a_long_tail(spark, long_tail):
    d, c = long_tail
    got = sorted(tuple(r) for r in network.network_analysis(spark, d).collect())
    want = sorted(c.execute(registry.oracle_sql()["network_analysis"]).fetchall())
    assert [(r[0], r[1], r[2], r[4], r[5]) for r in got] == [(r[0], r[1], r[2], r[4], r[5]) for r in want]
    assert all(abs(a[3] - b[3]) < 2e-9 for a, b in zip(got, want, strict=True))


@pytest.mark.parametrize("many", [1, 3, 10**6])
def test_core_numbers_do_not_depend_on_who_reads(spark, monkeypatch, many):
    """By every node, by short ones alone, and by both in turn; lists of a hub in pieces."""
    monkeypatch.setattr(graph, "MANY_FALL", many)
    monkeypatch.setattr(graph, "MANY_SHORT", many)
    monkeypatch.setattr(graph, "LONG_LIST", 4)
    edges = random_edges(6, 40, 200) | {(k, 500) for k in range(40)} | {(500, k) for k in range(0, 40, 2)} | {(k, k + 1) for k in range(100, 105)}
    e = table(spark, edges)
    layout = graph.EdgeLayout(e)
    for lists, key, item in ((layout.out_lists, "src", "dst"), (layout.in_lists, "dst", "src")):
        assert lists.where("size(items) > 25").count() == 0
        assert {(r[key], r["item"]) for r in lists.selectExpr(key, "explode(items) as item").collect()} == {(s, d) if key == "src" else (d, s) for s, d in edges}
    for rounds in (4, None):
        got = {r.node: r.core for r in graph.core_numbers(layout, rounds=rounds).collect()}
        assert got == rounds_of_cores(edges, rounds or 60), rounds
    layout.drop()


def test_rounds_in_which_most_nodes_fall_exchange_the_edges_once(spark, monkeypatch):
    """Numbers go to their targets, counted by value, and counts to their node: two exchanges a round, none of them of the edges' sources."""
    found, real = [], (graph.stash, graph.stash_bucketed)

    def plans(make):
        def made(df, name, *more, **by):
            if name.startswith("cores"):
                found.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
            return make(df, name, *more, **by)

        return made

    layout = graph.EdgeLayout(table(spark, random_edges(3, 60, 900)))
    monkeypatch.setattr(graph, "stash", plans(real[0]))
    monkeypatch.setattr(graph, "stash_bucketed", plans(real[1]))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        graph.core_numbers(layout, rounds=2)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
        layout.drop()
    assert 0 < sum(found) <= 4, found
