"""The filter audit against a plain enumeration of every order, document by document."""

import re
from collections import Counter
from itertools import permutations

import pytest
from llm_support import ODD_ROWS, SCHEMA, frame, sentence

from citeloom.llm import filter_audit
from citeloom.llm.filter_audit import LETTERS


def failed(text, doc_id, first):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    tests = {
        "A": len(ws) < 100,
        "B": 100 * len(set(ws)) < 80 * len(ws),
        "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
        "D": bool(re.search("[#$%&*|]", text)),
        "E": doc_id is not None and first is not None and doc_id > first,
    }
    return {letter for letter, bad in tests.items() if bad}


def brute(docs, labels):
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    ids: dict = {}
    for i, t, *_ in docs:
        if i is not None:
            ids[t or ""] = min(i, ids.get(t or "", i))
    rows = [(lang or "", failed(t or "", i, ids.get(t or "")), i in good, i in toxic) for i, t, lang, _ in docs]
    out, removed = {}, Counter()
    for part in {r[0] for r in rows}:
        for order in permutations(LETTERS):
            left = [r for r in rows if r[0] == part]
            gone = []
            for step, letter in enumerate(order, 1):
                here = [r for r in left if letter in r[1]]
                redundant = sum(letter in r[1] for r in gone)
                left = [r for r in left if letter not in r[1]]
                gone += here
                alone = sum(r[0] == part and r[1] == {letter} for r in rows)
                removed[part, letter] += len(here)
                out[part, "".join(order), step] = [len(left), len(here), redundant, alone, sum(r[2] for r in here), sum(r[3] for r in here), letter]
    return {k: (*v[:-1], removed[k[0], v[-1]]) for k, v in out.items()}


def ours(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def labels_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, quality int, toxic int, text string, mask int")


DISTINCT = " ".join(f"w{i}" for i in range(120))
DOCS = [
    *ODD_ROWS,
    (20, DISTINCT, "en", "a"), (21, DISTINCT, "de", "a"), (19, DISTINCT, None, "a"), (22, DISTINCT, "", "a"), (22, DISTINCT, "", "a"),
    (23, DISTINCT.upper(), "en", "a"), (24, DISTINCT + " #", "en", "a"), (25, DISTINCT.upper() + " $", "en", "a"), (26, sentence(5, 400) + " |", "en", "a"),
    (27, "A" * 10 + "é" * 90, "en", "a"), (28, "A" * 11 + "é" * 89, "en", "a"), (29, "Same Same %", "en", "a"), (30, "Same Same %", "en", "a"), (None, "Same Same %", "en", "a"), (None, None, None, None),
]
LABELS = [(1, 1, 0), (5, 0, 1), (5, 1, None), (20, 1, 1), (21, None, 1), (23, 1, 0), (26, 1, 1), (None, 1, 1), (30, 1, 0), (999, 1, 1), (2, None, None)]


def test_every_order_and_step_is_that_of_a_plain_count(spark):
    got, want = ours(filter_audit.filter_audit(frame(spark, DOCS), labels_of(spark, LABELS))), brute(DOCS, LABELS)
    assert got == want
    assert len(want) == len({lang or "" for _, _, lang, _ in DOCS}) * 600
    assert any(v[2] for v in got.values()) and any(v[3] for v in got.values()) and any(v[5] for v in got.values())


def test_shares_of_the_filters_add_up_to_all_that_goes(spark):
    got = filter_audit.filter_audit(frame(spark, DOCS), labels_of(spark, LABELS)).where("part = 'en'").collect()
    gone = {r.filter_order: sum(x.removed for x in got if x.filter_order == r.filter_order) for r in got}
    assert len(set(gone.values())) == 1
    shares = {r.filter_order[r.step - 1]: r.shapley for r in got}
    assert sum(shares.values()) == 120 * next(iter(gone.values()))


@pytest.mark.parametrize("empty", [True, False])
def test_empty_tables(spark, empty):
    docs = frame(spark, ODD_ROWS[:1])
    labels = labels_of(spark, LABELS)
    got = ours(filter_audit.filter_audit(docs.limit(0), labels) if empty else filter_audit.filter_audit(docs, labels.limit(0)))
    assert got == ({} if empty else brute(ODD_ROWS[:1], []))


def test_copies_of_a_third_of_all_rows(spark):
    docs = [(i, "Same text" if i % 3 else sentence(i, 130), "en" if i % 2 else None, "a") for i in range(600)]
    got = ours(filter_audit.filter_audit(spark.createDataFrame([(*d, 0, 0.0, 0, "", 0, "") for d in docs], SCHEMA), labels_of(spark, LABELS)))
    assert got == brute(docs, LABELS)


def test_same_rows_as_sql(spark, oracle):
    from support import DATA, rows

    assert rows(filter_audit.query(spark, DATA).toPandas()) == rows(oracle.execute(filter_audit.ORACLE_SQL).df())
