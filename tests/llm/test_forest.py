"""The LSH forest against all pairs of plain shingle sets."""

import random
import re

import numpy as np
import pytest
from llm_support import ODD_ROWS, frame, sentence

from citeloom.llm import minhash_forest as forest


def shingles(text, n=4):
    ws = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(ws)} if 0 < len(ws) < n else {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}


def brute(docs):
    """(doc_id, n_shingles, component_id, kept) of every row, sorted."""
    sets = [shingles(t) for _, t, *_ in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    names: dict = {}
    for i, (doc_id, *_) in enumerate(docs):
        if doc_id is not None:
            names[find(i)] = min(doc_id, names.get(find(i), doc_id))
    rows = [(d[0], len(s), names.get(find(i)), d[0] == names.get(find(i))) for i, (d, s) in enumerate(zip(docs, sets, strict=True))]
    return sorted(rows, key=repr)


def ours(df):
    return sorted([(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()], key=repr)


def changed(words, rng, share):
    return [w if rng.random() > share else f"{w}{rng.randrange(9)}" for w in words]


@pytest.fixture(scope="module")
def families():
    """Families of copies with more and more changes, templates that share most of their words, and single texts."""
    rng = random.Random(5)
    docs = []
    for k in range(8):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([4, 5, 8, 40, 200, 900]))]
        for c in range(12):
            docs.append(" ".join(changed(base, rng, 0.012 * (c % 6))))
    template = [f"t{i}" for i in range(120)]
    for k in range(60):
        docs.append(" ".join(template + [f"u{rng.randrange(10**6)}" for _ in range(rng.choice([10, 24, 30, 40]))]))
    docs += [sentence(k, 150) for k in range(40)]
    docs += [docs[3].upper()] * 5
    order = list(range(len(docs)))
    rng.shuffle(order)
    return [(1000 + i, docs[j], "en", "a") for i, j in enumerate(order)]


@pytest.mark.parametrize(("crowd", "levels"), [(4096, 3), (12, 2), (5, 0)])
def test_components_are_those_of_all_pairs(spark, families, monkeypatch, crowd, levels):
    """With regions as they are, with regions that have to be divided, and with regions in blocks alone."""
    monkeypatch.setattr(forest, "CROWD", crowd)
    monkeypatch.setattr(forest, "LEVELS", levels)
    monkeypatch.setattr(forest, "BLOCK", 256 if levels == 3 else 7)
    got = ours(forest.minhash_forest(frame(spark, families)))
    assert got == brute(families)
    assert sum(not r[3] for r in got) > 30


def test_links_that_neighbours_miss_are_found_in_regions(spark, families, monkeypatch):
    monkeypatch.setattr(forest, "neighbours", lambda members, trees: spark.createDataFrame([], "a long, b long"))
    assert ours(forest.minhash_forest(frame(spark, families))) == brute(families)


def test_overlaps_are_those_of_the_sets():
    rng = np.random.default_rng(1)
    left, right = ([np.unique(rng.integers(0, 9000, n)) for n in sizes] for sizes in ((3, 400, 6000), (1, 50, 5000, 900)))
    assert forest.overlaps(left, right).tolist() == [[len(np.intersect1d(a, b)) for b in right] for a in left]


def test_odd_rows(spark):
    docs = [*ODD_ROWS, (None, sentence(2, 60), "en", "b"), (None, "only null ids here twice", "en", "b"), (None, "only null ids here twice", "en", "b"), (20, "One TWO", "en", "a"), (21, "a b c d", "en", "a"), (22, "a b c d", "en", "a"), (23, "", "en", "a")]
    assert ours(forest.minhash_forest(frame(spark, docs))) == brute(docs)


def test_empty_table(spark, empty):
    assert ours(forest.minhash_forest(empty)) == []
    assert ours(forest.minhash_forest(frame(spark, [(1, None, "en", "a"), (2, " ", "en", "a")]))) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(3)
    every = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    misses = 0
    for n in (9, 90, 900):
        for _ in range(60):
            pick = rng.choice(every, n + n // 9 * 2, replace=False)
            a, b = pick[: n + n // 9], np.concatenate([pick[:n], pick[n + n // 9 :]])
            assert len(np.intersect1d(a, b)) * 100 >= 80 * len(np.union1d(a, b))
            x, y = forest.minhashes([np.sort(a), np.sort(b)])
            regions = (x.reshape(forest.TREES, -1) == y.reshape(forest.TREES, -1)).all(axis=1)
            misses += not regions.any() or (x == y).sum() < forest.AGREE
    assert misses == 0


def test_same_rows_as_sql(spark, oracle):
    from support import DATA, rows

    assert rows(forest.query(spark, DATA).toPandas()) == rows(oracle.execute(forest.ORACLE_SQL).df())
