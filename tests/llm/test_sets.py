"""Near-duplicate join, search, rules and mixing against plain versions and SQL."""

import random
import re

import duckdb
import numpy as np
import pytest
from llm_support import sentence
from pyspark.sql import functions as F
from support import DATA, rows

from citeloom.llm import mixing, ngram_join, quality_rules, topk_search
from citeloom.llm.queries import oracle_sql, queries


def plain_sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set())
    return out


def plain_join(ids, texts):
    sets, root, links = plain_sets(texts), list(range(len(ids))), [0] * len(ids)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i in range(len(ids)):
        least[find(i)] = min(least.get(find(i), 1 << 60), ids[i])
    return sorted((ids[i], len(sets[i]), least[find(i)], links[i]) for i in range(len(ids)))


def near_copies(seed, groups, copies, n):
    g, texts = random.Random(seed), []
    for k in range(groups):
        base = [f"w{g.randrange(5000)}" for _ in range(n(g))]
        for _ in range(copies):
            words = list(base)
            for _ in range(g.randrange(0, max(2, len(base) // 30))):
                at = g.randrange(len(words))
                words[at : at + g.choice((0, 1))] = [f"x{g.randrange(50)}"] * g.choice((0, 1))
            texts.append(" ".join(words))
        texts.append(f"{' '.join(base[:60])} " + " ".join(f"y{g.randrange(5000)}" for _ in range(80)))
    return texts + ["", "a", "a b", "A  b", "a b c", texts[0]]


@pytest.mark.parametrize("seed,groups,copies", [(1, 12, 8), (2, 1, 90), (3, 40, 2)])
def test_join_finds_every_link(spark, monkeypatch, seed, groups, copies):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    texts = near_copies(seed, groups, copies, lambda g: g.choice((3, 9, 10, 11, 13, 14, 15, 40, 200)) if groups > 1 else 150)
    ids = [100 + 3 * i for i in range(len(texts))]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in ngram_join.ngram_join(docs).collect())
    assert got == plain_join(ids, texts)


def test_linked_sets_always_share_a_range():
    g = np.random.default_rng(4)
    for n in (10, 11, 19, 20, 27, 28, 100, 333, 1000):
        for _ in range(30):
            a = np.unique(g.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            total = len(a)
            while True:
                total += 1
                if ngram_join.needed(len(a) + total) > len(a):
                    break
            b = np.unique(np.concatenate([a, g.integers(0, 1 << 63, total - 1 - len(a), dtype=np.uint64)]))
            assert set(ngram_join.signatures(a)) & set(ngram_join.signatures(b)), (n, len(b))


def test_join_links_a_text_of_eleven_words_with_one_of_twelve(spark):
    base = [f"w{i}" for i in range(11)]
    texts = [" ".join(base), " ".join(["x", *base]), " ".join([*base, "y"]), " ".join(base[:10]), " ".join(f"v{i}" for i in range(11)), " ".join(base)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(r) for r in ngram_join.ngram_join(docs).collect())
    assert got == plain_join(range(len(texts)), texts) and got[0] == (0, 9, 0, 3)


def test_sets_below_the_first_size_link_only_if_equal():
    n = ngram_join.FIRST_SIZE
    assert all(ngram_join.needed(2 * a + 1) > a for a in range(1, n)) and ngram_join.needed(2 * n + 1) <= n
    base = np.arange(1, 11, dtype=np.uint64) << np.uint64(60)
    for k in range(10):
        assert set(ngram_join.signatures(base)) & set(ngram_join.signatures(np.delete(base, k))), k


def test_trie_counts_as_a_plain_join():
    g = random.Random(6)
    base = [g.getrandbits(64) for _ in range(120)]
    sets = [np.unique(np.array([x for x in base if g.random() > 0.04] + [g.getrandbits(64) for _ in range(g.randrange(5))], np.uint64)) for _ in range(40)]
    got = {(i, int(j)) for i, found in ngram_join.Trie(sets).join(sets) for j in found}
    want = {(i, j) for i in range(40) for j in range(40) if 100 * len(set(sets[i].tolist()) & set(sets[j].tolist())) >= 90 * len(set(sets[i].tolist()) | set(sets[j].tolist()))}
    assert got == want


def test_join_of_odd_rows(odd, empty):
    got = {}
    for r in ngram_join.ngram_join(odd).collect():
        got.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.n_links))
    assert len(got[5]) == 2 and {x[1:] for x in got[5] + got[1]} == {(1, 2)}
    assert got[2] == got[3] == [(0, got[2][0][1], 0)] or (got[2], got[3], got[4]) == ([(0, 2, 0)], [(0, 3, 0)], [(0, 4, 0)])
    assert got[7] == [(1, 7, 0)] and got[11] == [(1, 11, 0)]
    assert ngram_join.ngram_join(empty).count() == 0


def test_search_beyond_64_bits(spark):
    big = float(np.float32(3e38))
    rows = [(0, [1.0, big]), (1, [big, 1.0]), (2, [big, big]), (3, [-big, -big]), (4, [float(2**40), 0.5])]
    found = topk_search.topk(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=3).collect()
    most, up = 2**63 - 1, 2**62
    assert [(r["rank"], r.vec_id, r.score) for r in sorted(found, key=lambda r: r["rank"])] == [(1, 1, most), (2, 2, most), (3, 4, min(most, 1024 * 2**50 + 512 * up))]


def test_null_ids_send_one_text_each(spark):
    texts = [sentence(k, 40 + k % 7) for k in range(150)]
    docs = spark.createDataFrame([(None, t) for t in texts for _ in range(2)] + [(1, texts[0])], "doc_id long, text string")
    sets = ngram_join.document_sets(docs)
    wanted = sets.groupBy("set_id").agg(F.min(F.struct("text_sum", F.col("doc_id").isNull().alias("no_id"), "doc_id")).alias("from"))
    sent = ngram_join.texts_of(docs, wanted).select("set_id", "text").collect()
    assert len(sent) == len({r.set_id for r in sent}) == 150
    got = ngram_join.ngram_join(docs).collect()
    assert sorted(r.n_links for r in got) == [1] * 298 + [2] * 3
    assert [r.component_id for r in got if r.component_id is not None] == [1, 1, 1]


def test_search_of_odd_vectors(spark):
    g = np.random.default_rng(0)
    vectors = [(i, [float(np.float32(x)) for x in g.standard_normal(6)]) for i in range(400)]
    vectors += [(100, vectors[7][1]), (7, vectors[7][1]), (500, None), (600, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (700, [float("nan")] * 6), (800, [float("inf")] * 6), (None, vectors[1][1]), (900, [0.0] * 6), (1000, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors], "vec_id long, embedding array<float>, score int, rank int")
    got = {}
    for r in topk_search.topk(df, every=100).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    good = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q, v in good:
        if q % 100 == 0:
            mine = [x for i, x in good if i == q]  # rows of one vec_id are one query
            scored = sorted((-sum(a * b for a, b in zip(x, w, strict=True)), i) for x in mine for i, w in good if i != q and len(w) == len(x))[:10]
            assert sorted(got.get(q, [])) == [(n + 1, i, -s) for n, (s, i) in enumerate(scored)], q
    assert topk_search.topk(df.limit(0)).count() == 0


def plain_topk(ids, vectors, query_ids, queries, k=10):
    return [sorted((-int(q @ v), int(i)) for i, v in zip(ids, vectors, strict=True) if i != own)[:k] for own, q in zip(query_ids, queries, strict=True)]


@pytest.mark.parametrize("seed", range(40))
def test_ties_are_never_pruned(monkeypatch, seed):
    g = np.random.default_rng(seed)
    monkeypatch.setattr(topk_search, "LEAF", 2)
    monkeypatch.setattr(topk_search, "QUERY_LEAF", 1)
    q = g.integers(1, 60, 2)
    # rows on the line of one score, and others
    line = np.array([[q[1] * t + q[0], -q[0] * t + q[1]] for t in g.integers(-9, 9, 30)])
    rows_ = np.concatenate([line, g.integers(-40, 40, (40, 2))]).astype(np.int64)
    ids = g.permutation(1000)[: len(rows_)].astype(np.int64)
    queries_ = np.stack([q, q, g.integers(-50, 50, 2)]).astype(np.int64)
    query_ids = np.array([2000, 2100, int(ids[3])])
    got, scores = topk_search.block_topk(query_ids, queries_, ids, rows_)
    assert [[(-s, i) for i, s in zip(a, b, strict=True)] for a, b in zip(got.tolist(), scores.tolist(), strict=True)] == plain_topk(ids, rows_, query_ids, queries_)


def test_clustered_rows_are_pruned():
    g = np.random.default_rng(1)
    centres = g.standard_normal((10, 16)) * 2000
    rows_ = np.floor(centres[g.integers(0, 10, 8000)] + g.standard_normal((8000, 16)) * 60).astype(np.int64)
    scored: list[int] = []
    ids, _ = topk_search.block_topk(np.arange(10_000, 11_000), rows_[:1000], np.arange(8000), rows_, scored=scored)
    assert sum(scored) < 0.35 * 1000 * 8000
    assert ids[5].tolist() == [i for _, i in plain_topk(np.arange(8000), rows_, [10_005], rows_[5:6])[0]]


def test_cells_and_blocks_find_the_same(spark, monkeypatch):
    g = np.random.default_rng(9)
    vectors = np.concatenate([g.standard_normal((6, 8))[g.integers(0, 6, 900)] * 3 + g.standard_normal((900, 8)) * 0.2, np.ones((300, 8))])
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(5)
    want = plain_topk(range(1200), q := np.floor(vectors * 1024).astype(np.int64), range(0, 1200, 100), q[::100])
    monkeypatch.setattr(topk_search, "ROW_BLOCK", 64)
    monkeypatch.setattr(topk_search, "CELLS", 7)
    got = {}
    for r in topk_search.topk(df).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (-r.score, r.vec_id)
    assert [[got[q][n] for n in range(1, 11)] for q in range(0, 1200, 100)] == want


def test_rules_of_odd_rows(odd, empty):
    got = {r.doc_id: r for r in quality_rules.quality_rules(odd).collect()}
    assert all(got[i].n_words == 0 and got[i].base_failed and not got[i].kept for i in (2, 3, 4))
    assert got[7].n_words == 1 and got[7].word_chars == 300_000
    assert quality_rules.quality_rules(odd).count() == odd.count() and quality_rules.quality_rules(empty).count() == 0


def test_rule_counts_against_plain_python(spark):
    texts = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(80).collect()] + [None, "a b a b a b", "a\n\n a \na\nb\n\x0bc", "# x|y <z>", "a b c d a b c " + sentence(1, 90)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen, hit = {}, set()
        for k in range(len(w) - 2):
            seen.setdefault(tuple(w[k : k + 3]), []).append(k)
        for at in seen.values():
            if len(at) > 1:
                hit |= {k + d for k in at for d in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, (i, t[:80])
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and not (r.kept and r.base_failed)


def test_distance_is_jensen_shannon(spark):
    p, q = [0.5, 0.5, 0.0], [0.25, 0.25, 0.5]
    d = spark.createDataFrame([(p, q)], "p array<double>, q array<double>").select(quality_rules.js_distance("p", "q")).first()[0]
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    kl = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m, strict=True) if x > 0)
    assert abs(d - np.sqrt((kl(p) + kl(q)) / 2)) < 1e-9


def test_mix_of_odd_rows(odd, empty):
    got = mixing.mix(odd).toPandas()
    assert len(got) == odd.count() and (got.taken <= 3 * got["size"]).all() and (got[got["size"] == 0].taken == 0).all()
    sources = got.drop_duplicates("target")
    assert abs(sources.target.sum() - got["size"].sum()) < 1e-6 * got["size"].sum() + 1e-6
    assert mixing.mix(empty).count() == 0
    rows_ = mixing.mixed_documents(odd)
    assert rows_.columns == odd.columns and rows_.count() > 0 and mixing.mixed_documents(empty).count() == 0


def test_mix_targets_and_repeats(spark):
    docs = spark.createDataFrame([(i, sentence(i, 20 + i % 7), f"s{i % 5}") for i in range(3000)] + [(9000, "tiny text", "s9")], "doc_id long, text string, source string")
    one, two = (sorted(tuple(r) for r in mixing.mix(docs.repartition(n)).collect()) for n in (1, 5))
    assert one == two
    got = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    for r in got:
        assert abs(r.t - r.g) <= 30, r
    by_copy = mixing.mixed_documents(docs).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in by_copy} == {i: t // s for i, s, _, _, t, _ in one if t}


def test_mix_of_repeated_rows(spark):
    rows_ = [(7, sentence(1, 100), "a")] * 50 + [(i, sentence(i, 100), "b") for i in range(100, 150)] + [(None, sentence(i, 100), "c") for i in range(40)] + [(None, sentence(3, 100), "c")] * 60
    docs = spark.createDataFrame(rows_, "doc_id long, text string, source string").repartition(7)
    got = mixing.mix(docs).toPandas()
    docs.toPandas().pipe(lambda d: duckdb.register("documents", d))
    want = duckdb.sql(mixing.ORACLE_SQL).df()
    assert rows(got) == rows(want)
    for size, part in got.groupby("source_size"):
        assert (abs(part.groupby("target").taken.sum() - part.groupby("target").target.first()) <= 50).all(), size
    assert got[got.doc_id.isna()].taken.nunique() > 1  # null doc_ids have their own draws
    mixed = {r["source"]: r["count"] for r in mixing.mixed_documents(docs).groupBy("source").count().collect()}
    assert mixed["a"] == got[got.doc_id == 7].taken.sum() // 100 and sum(mixed.values()) == got.taken.sum() // 100


def test_mix_bins_down_to_few_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "x" * (1 + i % 900) + " " + sentence(i, 20 + i % 7), f"s{i % 2}") for i in range(3000)], "doc_id long, text string, source string")
    want = rows(mixing.mix(docs).toPandas())
    monkeypatch.setattr(mixing, "SORT_ROWS", 1)
    monkeypatch.setattr(mixing, "BIN_BITS", 4)
    assert rows(mixing.mix(docs).toPandas()) == want


def test_mixed_documents_keep_columns_of_any_name(spark):
    names = ["_key", "_weight", "_size", "_copies", "epochs", "_last", "_in_bucket", "_row", "_end", "_times", "key", "size", "target", "cut", "s", "p", "_number", "_part", "_offset"]
    rows_ = [(i, sentence(i, 30), f"s{i % 2}", *[f"{n}{i}" for n in names]) for i in range(40)] + [(40, sentence(40, 30), "s0", *[f"{n}40" for n in names])] * 9
    docs = spark.createDataFrame(rows_, "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    known = {r[0]: r for r in rows_}
    got = got.collect()
    assert got and all(tuple(r) == known[r.doc_id] for r in got)


def test_one_of_each_group_stays(spark):
    a, b, c = sentence(1, 200), sentence(1, 200) + " end", sentence(7, 200)
    rows_ = [(5, a, "x"), (5, c, "y"), (1, b, "z"), (9, c, "v"), (9, c, "v"), (None, a, "n"), (3, None, "q"), (3, None, "q"), (4, "", "r"), (8, sentence(9, 90), "u"), (8, sentence(9, 90), "w")]
    docs = spark.createDataFrame(rows_, "doc_id long, text string, _doc_id string").repartition(3)
    got = sorted(((r.doc_id, r.text) for r in ngram_join.one_of_each(docs).collect()), key=repr)
    assert got == sorted([(1, b), (5, c), (3, None), (4, ""), (8, sentence(9, 90))], key=repr)
    assert ngram_join.one_of_each(docs).columns == docs.columns


def test_unrelated_long_texts_share_no_signature():
    g = np.random.default_rng(2)
    for n, m in ((3000, 400), (48_000, 20), (30, 3000)):
        sets = [np.unique(g.integers(0, 1 << 64, n, dtype=np.uint64)) for _ in range(m)]
        sent = np.concatenate([np.unique(ngram_join.signatures(x)) for x in sets])
        assert len(sent) - len(np.unique(sent)) <= (0 if n > 100 else 60), n


def test_crowded_sets_share_a_signature_too():
    base = np.sort(np.random.default_rng(3).choice(1 << 20, 50, replace=False)).astype(np.uint64)  # all in one range
    for k in range(3):
        assert set(ngram_join.signatures(base)) & set(ngram_join.signatures(np.append(base[k:], np.uint64(1 << 63))))


def test_hubs_are_joined_as_others(spark, monkeypatch):
    from citeloom.operators import components

    g = random.Random(4)
    edges = [(0, i) for i in range(1, 200)] + [(g.randrange(300, 400), g.randrange(300, 400)) for _ in range(60)] + [(500 + i, 501 + i) for i in range(40)]
    df = spark.createDataFrame(edges, "a long, b long")
    want = sorted(tuple(r) for r in components.connected_components(df).collect())
    monkeypatch.setattr(components, "HUBS", 10)
    assert sorted(tuple(r) for r in components.connected_components(df).collect()) == want
    assert all(c == 0 for n, c in want if n < 200) and all(c == 500 for n, c in want if n >= 500)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows_as_sql(spark, oracle, name):
    ours, theirs = queries()[name](spark, DATA).toPandas(), oracle.execute(oracle_sql()[name]).df()
    assert rows(ours) == rows(theirs)


def test_duckdb_is_there():
    assert duckdb.connect().execute("select 1").fetchone() == (1,)


def test_every_language_has_a_reference(spark):
    docs = spark.createDataFrame([(i, sentence(i, 80), f"l{i:02}", "a") for i in range(70)], "doc_id long, text string, lang string, source string")
    langs = [r.lang for r in quality_rules.language_references(quality_rules.text_counts(docs)).collect()]
    assert sorted(x for x in langs if x is not None) == [f"l{i:02}" for i in range(70)] and langs.count(None) == 1


def test_verdict_against_plain_python(spark):
    import math

    g = random.Random(2)
    words = {"en": "the and of to in a river stone light".split(), "de": "der die und in ist mit haus weg licht".split()}
    texts = [(i, " ".join(g.choice(words[lang]) + g.choice(["", "", ",", ".", "x", "yz"]) for _ in range(g.choice([20, 60, 90, 200]))), lang) for i, lang in enumerate(["en", "de"] * 30)]
    texts += [(100, " ".join(f"W{k}9%" for k in range(120)), "en"), (101, "THE " * 10 + " ".join(f"Q{k}" for k in range(90)), None), (102, "the same three words again " * 30, "de"), (103, None, "en"), (104, " ".join(f"zu{k}" for k in range(100)), "xx")]
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(texts, "doc_id long, text string, lang string")).collect()}

    def histograms(t):
        own = re.findall(r"[^\x20\x09-\x0D]+", t)
        chars = [0] * 5
        for c in t:
            kind = 3 if re.match(r"[\x20\x09-\x0D]", c) else 1 if c.isupper() else 2 if c in "0123456789" else 4 if c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else 0
            chars[kind] += 1
        common = [sum(w.lower() == x for w in own) for x in quality_rules.WORDS]
        return chars, [*common, len(own) - sum(common)], len(own)

    def failed(t):
        own = re.findall(r"[^\x20\x09-\x0D]+", t)
        at = {}
        for k in range(len(own) - 2):
            at.setdefault(tuple(own[k : k + 3]), []).append(k)
        hit = {k + d for ks in at.values() if len(ks) > 1 for k in ks for d in range(3)}
        return len(own) < 50 or 100 * len(hit) > 50 * len(own)

    def distance(p, q):
        p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
        m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
        kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m, strict=True) if x > 0)
        return math.sqrt(max((kl(p) + kl(q)) / 2, 0))

    made = {i: (*histograms(t or ""), failed(t or ""), lang) for i, t, lang in texts}
    add = lambda rows: [[sum(x) for x in zip(*(r[k] for r in rows), strict=True)] for k in (0, 1)]
    good = [m for m in made.values() if not m[3]]
    pooled = add(good)
    for i, (chars, common, n, bad, lang) in made.items():
        own = [m for m in good if m[4] == lang and lang is not None]
        ref = add(own) if own else pooled
        kept = not bad
        if sum(chars) >= quality_rules.GUARD_CHARS:
            kept &= distance(chars, ref[0]) <= quality_rules.MAX_CHAR_DISTANCE
        if n >= quality_rules.GUARD_WORDS:
            kept &= distance(common, ref[1]) <= quality_rules.MAX_WORD_DISTANCE
        assert (got[i].base_failed, got[i].kept) == (bad, kept), i
    assert {r.kept for r in got.values() if not r.base_failed} == {True, False}
