"""Registered queries that have to reach every row, against plain versions on small tables."""

import pandas as pd
from support import DATA

from citeloom.plans import catalog


def test_every_author_is_compared(spark, tmp_path):
    names = {k: f"Author {chr(97 + k) * 3}" for k in range(1, 8)}
    status = {2: "F", 3: "O", 4: "F", 5: "F", 6: "P", 7: "F", 8: "O"}
    lines = [(2, 1, 1), (2, 2, 2), (3, 1, 1), (4, 3, 1), (5, 4, 1), (5, 5, 2), (6, 4, 1), (7, 6, 1), (8, 7, 1)]
    pd.DataFrame({"s_suppkey": list(names), "s_name": list(names.values())}).to_parquet(tmp_path / "supplier.parquet")
    pd.DataFrame({"o_orderkey": list(status), "o_orderstatus": list(status.values())}).to_parquet(tmp_path / "orders.parquet")
    pd.DataFrame(lines, columns=["l_orderkey", "l_suppkey", "l_linenumber"]).to_parquet(tmp_path / "lineitem.parquet")
    theirs = {k for seq, k, _ in lines if status[seq] != "F"}
    want = sorted((seq, n, names[k]) for seq, k, n in lines if status[seq] == "F" and k in theirs)
    got = sorted(tuple(r) for r in catalog.queries()["author_intersect"](spark, str(tmp_path)).collect())
    assert got == want and any(seq % 2 for seq, _, _ in got)


def test_years_are_ordered_over_all_rows(spark):
    got = [(r.seq, r.year) for r in catalog.queries()["sort_year"](spark, DATA).collect()]
    assert len(got) == spark.read.parquet(f"{DATA}/documents.parquet").count() > 50
    assert got == sorted(got, key=lambda r: (-(r[1] or 0), r[0]))


def test_snowball_goes_past_ten_neighbours_and_one_round(spark, tmp_path):
    # part 30 rows: work 0 is cited by none; it cites 1 to 15, and 15 cites 16, which 17 to 29 cite
    lines = [(30, k) for k in range(1, 16)] + [(15, 16)] + [(k, 16) for k in range(17, 30)] + [(16, k) for k in range(17, 30)]
    pd.DataFrame({"p_partkey": range(1, 31)}).to_parquet(tmp_path / "part.parquet")
    pd.DataFrame(lines, columns=["l_orderkey", "l_partkey"]).to_parquet(tmp_path / "lineitem.parquet")
    got = {(r.node, r.depth, r.is_new) for r in catalog.queries()["snowball_round"](spark, str(tmp_path)).collect()}
    want = {(k, 1, True) for k in range(1, 16)} | {(0, 2, False), (16, 2, True)} | {(15, 3, False)} | {(k, 3, True) for k in range(17, 30)} | {(16, 4, False)}
    assert got == want
