"""Hard negatives against a search of all pairs."""

import math

import numpy as np
import pytest

from citeloom.llm import hard_negatives as hn

KIND = "vec_id long, embedding array<float>, label int, score double, deal long, dim string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0.5, 3, "x") for r in rows], KIND)


def kept(rows):
    return [(i, [max(-hn.LARGEST, min(hn.LARGEST, math.floor(256 * float(x)))) for x in v], label) for i, v, label in rows if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v)]


def brute(rows, positives=5, negatives=5):
    own, out = kept(rows), []
    clip = lambda s: max(-(2**63) + 1, min(2**63 - 1, s))
    for anchor, (a, v, label) in enumerate(own):
        if a % 100:
            continue
        scored = sorted((-clip(sum(x * y for x, y in zip(v, w, strict=True))), i, other) for b, (i, w, other) in enumerate(own) if b != anchor and i != a and len(w) == len(v))
        for p, positive, _ in [x for x in scored if x[2] == label][:positives]:
            fits = [(s, i) for s, i, other in scored if other != label and 80 * -p <= 100 * -s <= 100 * -p][:negatives]
            out += [(a, positive, rank, i, -p, -s) for rank, (s, i) in enumerate(fits, 1)]
    return sorted(out)


def ours(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def clustered(n, dim, seed, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    which = rng.integers(0, 6, n)
    v = np.round(centres[which] + rng.normal(size=(n, dim)) * 0.15, 2).astype(np.float32)
    label = np.where(rng.random(n) < 0.3, 0, rng.integers(0, labels, n))
    return [(int(i), v[i].tolist(), int(label[i])) for i in range(n)]


@pytest.mark.parametrize(("levels", "rows"), [(8, 16_384), (3, 64), (0, 50)])
def test_rows_are_those_of_all_pairs(spark, monkeypatch, levels, rows):
    """With one cell, with several cells, and with several blocks in one cell."""
    monkeypatch.setattr(hn, "LEVELS", levels)
    monkeypatch.setattr(hn, "BLOCK_ROWS", rows)
    monkeypatch.setattr(hn, "block_rows", lambda dim: rows)
    data = clustered(700, 5, 1)
    got = ours(hn.hard_negatives(hn.labelled(frame(spark, data))))
    assert got == brute(data)
    assert len(got) > 60


def test_odd_vectors(spark):
    data = clustered(240, 3, 2, labels=2)
    data += [(0, None, 1), (None, [1.0, 2.0, 3.0], 1), (300, [1.0, None, 2.0], 1), (400, [float("nan"), 1.0, 1.0], 0), (500, [float("inf"), 1.0, 1.0], 0), (600, [1.0, 1.0, 1.0], None), (700, [], 1)]
    data += [(800, [1.0, 2.0], 1), (801, [1.0, 1.9], 1), (802, [1.0, 1.8], 0), (803, [1.0, 1.8], 0)]  # another length
    data += [(100, [0.1, 0.2, 0.3], 1), (900, [0.0, 0.0, 0.0], 1), (7, data[7][1], 0), (7, data[7][1], 1)]  # repeated ids, a score of 0 with all
    assert ours(hn.hard_negatives(hn.labelled(frame(spark, data)))) == brute(data)


def test_ties_go_to_the_smaller_id(spark):
    data = [(i, [1.0, 0.0], i % 2) for i in range(150, -1, -1)]
    got = ours(hn.hard_negatives(hn.labelled(frame(spark, data))))
    assert got == brute(data)
    assert [r[3] for r in got if r[:2] == (100, 0)] == [1, 3, 5, 7, 9]


def test_scores_beyond_doubles_and_beyond_64_bits(spark):
    near = [(i, [float(2**30), float(i)], i % 3) for i in range(120)]
    assert ours(hn.hard_negatives(hn.labelled(frame(spark, near)))) == brute(near)
    far = [(i, [float(np.float32(3e38)) if i % 2 else float(2**40), 1.0], i % 3) for i in range(110)]
    assert ours(hn.hard_negatives(hn.labelled(frame(spark, far)))) == brute(far)


def test_no_rows(spark):
    assert ours(hn.hard_negatives(hn.labelled(frame(spark, [(1, [1.0], 1)]).limit(0)))) == []
    assert ours(hn.hard_negatives(hn.labelled(frame(spark, [(100, [1.0], 1), (101, [-1.0], 1), (102, [-2.0], 0)])))) == []


def test_a_block_scores_few_rows_of_clusters():
    data = kept(clustered(4000, 6, 3))
    ids, labels, rows = np.array([d[0] for d in data]), np.array([d[2] for d in data]), np.array([d[1] for d in data], np.int64)
    block, scored = hn.Block(ids, labels, rows, leaf=32), []
    own = np.flatnonzero(ids % 100 == 0)
    most = np.full(len(own), np.iinfo(np.int64).max)
    found, scores = block.best(ids[own], labels[own], rows[own], -most, most, -most, True, 5, scored)
    every = hn.products(rows[own], rows)
    for r, i in enumerate(own.tolist()):
        fits = np.flatnonzero((labels == labels[i]) & (ids != ids[i]))
        best = fits[np.lexsort((ids[fits], -every[r, fits]))[:5]]
        assert scores[r].tolist() == every[r, best].tolist()
        assert found[r].tolist() == ids[best].tolist()
    assert sum(scored) < 0.5 * len(own) * len(rows)


def test_same_rows_as_sql(spark, oracle):
    from support import DATA, rows

    assert rows(hn.query(spark, DATA).toPandas()) == rows(oracle.execute(hn.ORACLE_SQL).df())
