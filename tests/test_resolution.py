"""Merges, persons, runs, ranks, clusters, sketches and payload paths against plain versions."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from citeloom.functions import paths
from citeloom.operators import arrival, corpus, dedup, ranks, review, skew, summaries
from citeloom.plans import search
from citeloom.sources import records_io

IDS = "array<struct<ns:string,value:string>>"


def records(spark, rows):
    """Rows of (seq, side, ids as "ns:value" texts)."""
    return spark.createDataFrame([(s, side, [tuple(i.split(":")) for i in ids], f"T{s}", "openalex", False, s % 5) for s, side, ids in rows], f"seq long, side int, ids {IDS}, title string, source_provider string, is_retracted boolean, cited_by_count int")


def folded(rows):
    """The entry that each record joins, by a plain walk over all entries."""
    entries, out = [], {}
    for seq, _, ids in sorted(rows, key=lambda r: (r[1], r[0])):
        for first, have in entries:
            if have & set(ids):
                have |= set(ids)
                out[seq] = first
                break
        else:
            entries.append((seq, set(ids)))
            out[seq] = seq
    return out


def test_arrival_differs_from_the_closure(spark):
    rows = [(1, 0, ["doi:a"]), (2, 0, ["arxiv:b"]), (3, 1, ["doi:a", "arxiv:b"]), (4, 1, ["arxiv:b"]), (5, 0, ["arxiv:c", "doi:d"]), (6, 1, ["doi:d"]), (7, 1, ["internal:7"])]
    df = records(spark, rows)
    got = {r.seq: r.entry for r in arrival.first_matches(df, [F.col("side")]).collect()}
    assert got == folded(rows) == {1: 1, 2: 2, 3: 1, 4: 1, 5: 5, 6: 5, 7: 7}
    one, other = corpus.Corpus(df.where("side = 0").drop("side")), corpus.Corpus(df.where("side = 1").drop("side"))
    kept = {r.seq: {i.value for i in r.ids} for r in one.merge(other, order="arrival").df.collect()}
    assert kept == {1: {"a", "b"}, 2: {"b"}, 5: {"c", "d"}, 7: {"7"}}
    assert {r.seq for r in one.merge(other).df.collect()} == {1, 5, 7}


def test_arrival_of_random_records(spark):
    rng = random.Random(8)
    rows = [(s, rng.randrange(2), sorted({f"doi:{rng.randrange(60)}" for _ in range(rng.randrange(4))})) for s in range(150)]
    got = {r.seq: r.entry for r in arrival.first_matches(records(spark, rows), [F.col("side")]).collect()}
    assert got == folded(rows)


def test_persons_by_orcid_or_name(spark):
    rng = random.Random(2)
    person = lambda k: (k, rng.choice([None, "o1", "o2", "o3"]), rng.choice([None, "ann", "bob", "cyd", "dan"]))
    mine, theirs = [person(k) for k in range(40)], [person(k) for k in range(6)]
    same = lambda a, b: a[1] == b[1] if a[1] and b[1] else a[2] is not None and a[2] == b[2]
    want = {a[0] for a in mine if any(same(a, b) for b in theirs)}
    frame = lambda rows: spark.createDataFrame(rows, "k int, orcid string, normalized string")
    got = [r.k for r in corpus.shared_persons(frame(mine), frame(theirs)).collect()]
    assert sorted(got) == sorted(want) and 0 < len(want) < 40


def titles(spark):
    rng = random.Random(3)
    rows = []
    for k in range(80):
        base = "".join(rng.choice("abcdef") for _ in range(30))
        for c in range(rng.randrange(1, 5)):
            rows.append((len(rows), base[:25] + ("x" if rng.random() < 0.4 else "") + base[25:], 2000 + rng.choice([0, 0, 1, 3])))
    rows += [(1000, "", 2000), (1001, None, 2000), (1002, rows[0][1], None)]
    return spark.createDataFrame(rows, "seq long, norm_title string, year int"), rows


def test_islands_go_over_ranges(spark):
    df, rows = titles(spark)
    want, last = [], None
    for s, t, y in sorted((r for r in rows if r[1]), key=lambda r: (r[1], r[0])):
        ratio = 0
        if last and (y is None or last[2] is None or abs(y - last[2]) <= 1):
            ratio = round((1 - duckdb.execute("select levenshtein(?, ?)", [t, last[1]]).fetchone()[0] / max(len(t), len(last[1]))) * 100)
        if ratio >= 95:
            want[-1].append(s)
        else:
            want.append([s])
        last = (s, t, y)
    got = sorted((r.island, r.first_seq, r.last_seq, r.size) for r in ranks.fuzzy_islands(df).collect())
    assert got == [(k, g[0], g[-1], len(g)) for k, g in enumerate(want, 1)]
    assert any(len(g) > 2 for g in want)


@pytest.mark.parametrize("hubs", [1000, 4])
@pytest.mark.parametrize("descending", [True, False])
def test_ranks_are_those_of_windows(spark, monkeypatch, hubs, descending):
    monkeypatch.setattr(skew, "HUBS", hubs)
    rng = random.Random(4)
    rows = [(k, "hot" if rng.random() < 0.5 else rng.choice(["a", "b", None]), rng.choice([None, 1, 1, 1, 2, 3, 9])) for k in range(160)] + [(500, "one", 1)]
    df = spark.createDataFrame(rows, "seq long, part string, value int")
    got = sorted(((r.seq, r.place, r["rank"], round(r.percent_rank, 9), round(r.cume_dist, 9), r.tile) for r in ranks.ranked(df, "value", "seq", "part", descending, tiles=7).collect()))
    order = "DESC NULLS LAST" if descending else "ASC NULLS FIRST"
    w = f"partition by part order by value {order}"
    q = f"select seq, row_number() over ({w}, seq), rank() over ({w}), percent_rank() over ({w}), cume_dist() over ({w}), ntile(7) over ({w}, seq) from t order by seq"
    c = duckdb.connect()
    c.register("t", df.toPandas().astype({"value": "Int64"}))
    assert got == [(*r[:3], round(r[3], 9), round(r[4], 9), r[5]) for r in c.execute(q).fetchall()]


def test_running_sums_and_positions(spark):
    df = spark.range(0, 1000).select(F.col("id").alias("k"), (F.col("id") * 7919 % 1000).alias("v"))
    got = [(r.v, r.running) for r in ranks.with_running(df, [F.col("v")], "v").orderBy("v").collect()]
    assert got == [(v, v * (v + 1) // 2) for v in range(1000)]
    assert [r.position for r in ranks.with_position(df, [F.col("v")]).orderBy("v").collect()] == list(range(1, 1001))
    assert ranks.with_position(df.limit(0), [F.col("v")]).collect() == []


def test_sketches_merge_within_their_error(spark):
    df = spark.range(0, 60_000).select((F.col("id") % 7).alias("source"), (F.col("id") * 31 % 40_000).alias("v"))
    tables = summaries.sketches(df, "source", F.col("v"))
    all_, each = summaries.merged(tables).first()[0], {r.source: r.distinct_values for r in summaries.merged(tables, "source").collect()}
    exact = {r.source: r.n for r in df.groupBy("source").agg(F.count_distinct("v").alias("n")).collect()}
    error = 4 * 1.04 / 2 ** (summaries.SKETCH_K / 2)
    assert abs(all_ - 40_000) <= error * 40_000
    assert all(abs(each[s] - n) <= error * n for s, n in exact.items())
    assert max(len(r.sketch) for r in tables.collect()) < 6000


def test_paths_of_payloads(spark):
    data = '{"a": {"b": [{"c": "  x "}, {"c": 7.9}], "n": "12", "t": "y", "e-f": true, "z": null}, "list": [1, 2]}'
    df = spark.createDataFrame([(data,), ("no json",), (None,)], "j string").select(paths.parsed(F.col("j")).alias("v"))
    v = F.col("v")
    got = df.select(
        paths.get_string(v, "a.b.0.c"), paths.get_string(v, "a.b.5.c", "none"), paths.get_int(v, "a.b.1.c"), paths.get_int(v, "a.n"), paths.get_int(v, "a.t", -1),
        F.size(paths.get_list(v, "list")), F.size(paths.get_list(v, "a.t")), paths.get_first(v, "a.z", "a.q", "a.t"), paths.get_string(v, "a.e-f"),
    ).collect()
    assert tuple(got[0]) == ("x", "none", 7, 12, -1, 2, 0, "y", "true")
    assert tuple(got[1]) == tuple(got[2]) == ("", "none", None, None, -1, 0, 0, None, "")


def test_records_there_and_back(spark):
    kind = f"seq long, ids {IDS}, title string, authors array<struct<family:string,given:string,orcid:string>>, year int, venue struct<name:string,issn:string,type:string,publisher:string>, abstract string, cited_by_count int, is_retracted boolean, source_provider string"
    rows = [(1, [("doi", "10.1/A"), ("s2", "x")], "T", [("Doe", "J", None)], 2001, ("V", None, None, "P"), "abs", 3, True, "s2"), (2, [], "U", [], None, None, None, None, False, "arxiv")]
    back = records_io.from_payload(records_io.to_payload(spark.createDataFrame(rows, kind), "seq"), "seq").orderBy("seq").collect()
    assert [tuple(i) for i in back[0].ids] == [("doi", "10.1/a"), ("s2", "x")]
    assert (back[0].title, back[0].authors[0].family, back[0].year, tuple(back[0].venue), back[0].abstract, back[0].cited_by_count, back[0].is_retracted) == ("T", "Doe", 2001, ("V", None, "journal"), "abs", 3, True)
    assert (back[1].ids, back[1].authors, back[1].venue, back[1].year) == ([], [], None, None)
    broken = records_io.from_payload(spark.createDataFrame([(9, "{")], "seq long, payload string"), "seq").first()
    assert (broken.seq, broken.ids, broken.title) == (9, [], None)


def test_what_clusters_can_be_asked(spark):
    w = records(spark, [(1, 0, ["doi:a"]), (2, 0, ["doi:a", "arxiv:q"]), (3, 0, ["arxiv:q"]), (4, 0, ["doi:z"])]).withColumn("abstract", F.lit(None).cast("string")).withColumn("year", F.lit(2000))
    members = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4)], "seq long, cluster_id long")
    wanted = spark.createDataFrame([("arxiv", "q"), ("doi", "none")], "ns string, value string")
    assert [tuple(r) for r in dedup.clusters_of_ids(w, members, wanted).collect()] == [("arxiv", "q", 1)]
    head = {r.cluster_id: r.representative for r in dedup.elect(w, members).collect()}
    others = {r.seq for r in dedup.non_representatives(w, members).collect()}
    assert head[1] in (1, 2) and others == {3}  # 1 and 2 have one primary value
    assert {r.cluster_id: r["values"] for r in dedup.cluster_ids(w, members, "doi").collect()} == {1: ["a"], 4: ["z"]}
    assert {r.cluster_id: r.found for r in dedup.has_identifier(dedup.elect(w, members), w, "doi").collect()} == {1: True, 4: True}
    asked = spark.createDataFrame([(1, 3), (1, 4), (8, 8), (8, 9)], "a long, b long")
    assert {(r.a, r.b): r.connected for r in dedup.connected(members, asked).collect()} == {(1, 3): True, (1, 4): False, (8, 8): True, (8, 9): False}


def test_excluded_by_reason(spark):
    latest = spark.createDataFrame([("full", "exclude", "scope"), ("full", "exclude", " "), ("full", "exclude", None), ("full", "include", "scope")], "stage string, decision string, reason string")
    assert {(r.stage, r.reason, r.n) for r in review.excluded_by_reason(latest).collect()} == {("full", "scope", 1), ("full", "unspecified", 2)}


def test_all_sources_fail(spark):
    fetched = spark.createDataFrame([("openalex", 0, None, "down", 5), ("arxiv", 0, None, "no answer", 7)], "source string, page int, body string, error string, latency_ms long")
    result = search.federated(fetched)
    assert result.records.count() == 0 and result.total_raw == 0
    assert {(r.source_provider, r.result_count, r.skip_reason, r.latency_ms) for r in result.stats.collect()} == {("openalex", 0, "down", 5), ("arxiv", 0, "no answer", 7)}
