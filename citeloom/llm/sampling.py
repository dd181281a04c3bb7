"""Bounded, repeatable samples of labelled rows for the learned operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.common import drop_stash, stash

#: Texts beyond this many characters are not learned from (they are scored like all others).
MAX_LEARN_CHARS = 60_000


def _draw() -> Column:
    """The order in which rows are taken: a hash of doc_id."""
    return F.xxhash64(F.col("doc_id"), F.lit("learn"))


def labelled_texts(docs: DataFrame, labels: DataFrame, target: str, held: Column, n: int) -> tuple[list[tuple[str, int]], float]:
    """At most ``n`` texts of each label 0 and 1 outside ``held``, in the order of doc_id, and label 1's share.

    Labels of documents that are there with a text to learn from are drawn by the least hash of doc_id: exactly the ``n``
    first of each, so the same ones on every run.  Only these, at most ``2 * n`` rows, are broadcast.  A document with several texts is learned from by its least one; one with
    contradicting labels has label 0.
    """
    known = labels.select("doc_id", F.col(target).cast("int").alias("_label")).where(F.col("_label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held)
    known = known.groupBy("doc_id").agg(F.min("_label").alias("_label"))
    texts = docs.where(F.col("text").isNotNull() & (F.length("text") <= MAX_LEARN_CHARS)).select("doc_id", "text")
    known = stash(known.join(texts.select("doc_id"), "doc_id", "left_semi"), "sample-labels")
    counts = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    first = lambda label: known.where(F.col("_label") == label).orderBy(_draw(), "doc_id").limit(n)
    rows = texts.join(F.broadcast(first(0).union(first(1))), "doc_id").groupBy("doc_id", "_label").agg(F.min("text").alias("text")).collect()
    drop_stash(known)
    share = counts.get(1, 0) / max(sum(counts.values()), 1)
    return [(r["text"], r["_label"]) for r in sorted(rows, key=lambda r: r["doc_id"])], share


def texts_by_value(docs: DataFrame, column: str, held: Column, n: int, most: int, max_chars: int) -> dict[str, list[str]]:
    """The beginnings (``max_chars``) of at most ``n`` texts of each value of ``column`` outside ``held``, in hash order.

    With more than ``most / n`` values there are fewer texts of each, one at least.
    """
    known = docs.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held)
    values = known.agg(F.count_distinct(column).alias("n")).first()["n"]
    n = max(1, min(n, most // max(values, 1)))
    # each task keeps its n first of a value before anything is shuffled
    order = Window.partitionBy(column).orderBy("_draw", "doc_id", "_text")
    drawn = known.select(F.col(column).alias("_value"), "doc_id", _draw().alias("_draw"), F.xxhash64("text").alias("_text")).withColumnRenamed("_value", column)
    chosen = drawn.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n).select(F.col(column).alias("_value"), F.col("doc_id").alias("_id"), "_text", "_rank")
    texts = known.select(F.col(column).alias("_own"), "doc_id", "text")
    on = (F.col("_own") == F.col("_value")) & (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_text"))
    rows = texts.join(F.broadcast(chosen), on).select("_value", "_rank", F.substring("text", 1, max_chars).alias("text")).groupBy("_value", "_rank").agg(F.min("text").alias("text")).collect()
    out: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["_value"], r["_rank"])):
        out.setdefault(r["_value"], []).append(r["text"])
    return out
