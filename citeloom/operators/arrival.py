"""Merging in the order of arrival: a record joins the first one, in order of creation, that shares an identifier with it.

Unlike the transitive merge, two records that are apart stay apart when a later one connects them; that one joins the older.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.operators.corpus import fuse, identity_groups


def first_matches(df: DataFrame, order: list[Column]) -> DataFrame:
    """seq, entry: the record (by its seq) that each record is merged into; its own seq if it starts one.

    Only identifiers that several records have matter, and only records of one identity component (connected through
    them) can meet, so the fold runs component by component: rows arrive sorted, one at a time, and the state is the first entry of
    each identifier of the component at hand.  Texts and other columns take no part.
    """
    each = df.select("seq", F.explode("ids").alias("x")).select("seq", F.xxhash64("x.ns", "x.value").alias("id")).distinct()
    shared = each.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    ids = each.join(shared, "id", "left_semi").groupBy("seq").agg(F.collect_list("id").alias("ids"))
    arrival = df.select("seq", *[c.alias(f"k{i}") for i, c in enumerate(order)])
    keys = [f"k{i}" for i in range(len(order))]
    rows = ids.join(identity_groups(df), "seq").join(arrival, "seq").repartition("group").sortWithinPartitions("group", *keys, "seq").select("group", "seq", "ids")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, state, entries = None, {}, []
        for batch in batches:
            out = []
            for own, seq, found in zip(*(batch.column(c).to_pylist() for c in ("group", "seq", "ids")), strict=True):
                if own != group:
                    group, state, entries = own, {}, []
                at = min((state[i] for i in found if i in state), default=len(entries))
                if at == len(entries):
                    entries.append(seq)
                for i in found:
                    state[i] = min(state.get(i, at), at)
                out.append(entries[at])
            yield pa.RecordBatch.from_arrays([batch.column("seq"), pa.array(out, pa.int64())], names=["seq", "entry"])

    merged = rows.mapInArrow(fold, "seq long, entry long")
    return df.select("seq").join(merged, "seq", "left").select("seq", F.coalesce("entry", "seq").alias("entry"))


def merge_in_order(df: DataFrame, order: list[Column]) -> DataFrame:
    """One record per entry: fields of the first arrival, gaps filled from later ones, identifiers united."""
    entries = first_matches(df, order)
    keyed = df.join(entries, "seq")
    return fuse(keyed, "entry", [*order, F.col("seq")])
