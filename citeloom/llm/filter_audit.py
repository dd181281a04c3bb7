"""How filters of a corpus interact: what each removes, repeats or alone catches, in every order of applying them.

Five filters fail a document (words are runs of anything but white space; a null text is an empty one):

    A  under ``MIN_WORDS`` words                         D  holds any of ``SYMBOLS``
    B  distinct words under ``DISTINCT_PERCENT`` %       E  has the text of a document with a smaller doc_id
    C  A-Z over ``CAPITALS_PERCENT`` % of code points

A pass over the documents makes a mask of the filters that each text fails, one bit a filter, and a digest of the text
(SHA-256; equal digests are taken as equal texts).  The smallest doc_id of each digest is a pre-aggregated minimum; rows that are
not that one fail E.  That is found by a join on digest *and* doc_id, so thousands of copies of one text are no hot key.  All
the rest is read off at most 32 counts a part: an order's step removes the documents whose mask holds the step's bit and none of
the bits before it.

Nulls: a null doc_id is smaller than none, has no smaller one and no labels; a null lang and an empty one are the part "".
Repeated rows each count, and are not smaller than each other; a doc_id with several label rows is good or toxic if one of
them says so.  An empty text fails A alone (and E, if a smaller doc_id has none either).  Texts are read whole.  An empty
table gives no rows.  Columns other than doc_id, text and lang are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.llm.common import documents, drop_stash, stash, words

MIN_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT = 100, 80, 10
SYMBOLS = "[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Filters by bit: the first is bit 0.
LETTERS = "ABCDE"


def _mask(failed: list[Column]) -> Column:
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed)), F.lit(0))


def text_masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest, mask (bits A to D) of every row."""
    plain = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    split = plain.withColumn("words", words(F.col("text")))
    n, length = F.size("words"), F.char_length("text")
    failed = [
        n < MIN_WORDS,
        100 * F.size(F.array_distinct("words")) < DISTINCT_PERCENT * n,
        100 * (length - F.char_length(F.translate("text", CAPITALS, ""))) > CAPITALS_PERCENT * length,
        F.col("text").rlike(SYMBOLS),
    ]
    return split.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), _mask(failed).alias("mask"))


def with_repeats(masked: DataFrame, bit: int) -> DataFrame:
    """``masked`` with ``bit`` set where a smaller doc_id has the same digest."""
    first = masked.where(F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    found = masked.join(first, ["digest", "doc_id"], "left")
    return found.withColumn("mask", F.when(F.col("doc_id").isNull() | F.col("first"), F.col("mask")).otherwise(F.col("mask").bitwiseOR(bit))).drop("first")


def mask_cells(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: the histogram of the masks."""
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*[F.max((F.coalesce(c, F.lit(0)) == 1).cast("long")).alias(mark) for c, mark in (("quality", "good"), ("toxic", "toxic"))])
    rows = masked.where(F.col("doc_id").isNotNull()).join(marks, "doc_id", "left").select("part", "mask", "good", "toxic")
    rows = rows.union(masked.where(F.col("doc_id").isNull()).select("part", "mask", F.lit(None).cast("long"), F.lit(None).cast("long")))
    marked = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("good", "toxic")]
    return rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), *marked)


def audit(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """From part, mask, n, good, toxic: one row per part, order of the filters and step, with what happens at that step.

    A part has at most 2 ** len(letters) cells, which one row holds; its orders are enumerated from that row.
    """
    by_part = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    orders = F.split(F.lit(",".join("".join(p) for p in permutations(letters))), ",")
    steps = by_part.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))
    place = [F.instr("filter_order", letter) for letter in letters]
    steps = steps.withColumn("bit", _mask([p == F.col("step") for p in place])).withColumn("before", _mask([p < F.col("step") for p in place]))

    def total(of: str, where: Callable[[Column], Column]) -> Column:
        inside = F.filter("cells", lambda c: where(c["mask"]))
        return F.aggregate(inside, F.lit(0).cast("long"), lambda a, c: a + c[of])

    fails = lambda m: m.bitwiseAND(F.col("bit")) != 0
    gone = lambda m: m.bitwiseAND(F.col("before")) != 0
    here = lambda m: fails(m) & ~gone(m)
    counted = steps.select(
        "part", "filter_order", "step", "bit",
        total("n", lambda m: ~fails(m) & ~gone(m)).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda m: fails(m) & gone(m)).alias("redundant"),
        total("n", lambda m: m == F.col("bit")).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
    )
    # a filter of a part stands once in each order: a window of as many rows as there are orders
    return counted.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit"))).drop("bit")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    masked = stash(text_masks(docs), "audit-masks")
    cells = stash(mask_cells(with_repeats(masked, 1 << LETTERS.index("E")), labels), "audit-cells")
    drop_stash(masked)
    return audit(cells)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), m AS (
  SELECT doc_id, part, len(ws) < 100 AS a, 100 * len(list_distinct(ws)) < 80 * len(ws) AS b, 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS c,
    regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e FROM t
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, concat(CASE WHEN a THEN 'A' END, CASE WHEN b THEN 'B' END, CASE WHEN c THEN 'C' END, CASE WHEN d THEN 'D' END, CASE WHEN e THEN 'E' END) AS fails
  FROM m LEFT JOIN l ON m.doc_id = l.doc_id
), cells AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT v.x || w.x || y.x || z.x || u.x AS o FROM letters v, letters w, letters y, letters z, letters u
  WHERE len(list_distinct([v.x, w.x, y.x, z.x, u.x])) = 5
), steps AS (
  SELECT o AS filter_order, CAST(s AS INTEGER) AS step, substr(o, s, 1) AS x, substr(o, 1, s - 1) AS before FROM orders, range(1, 6) r(s)
), k AS (
  SELECT part, filter_order, step, x, n, good, toxic, fails, contains(fails, x) AS hit, before <> '' AND translate(fails, before, '') <> fails AS gone FROM steps, cells
), g AS (
  SELECT part, filter_order, step, x, CAST(coalesce(sum(n) FILTER (WHERE NOT hit AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (WHERE hit AND NOT gone), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (WHERE hit AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (WHERE fails = x), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (WHERE hit AND NOT gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (WHERE hit AND NOT gone), 0) AS BIGINT) AS toxic_lost
  FROM k GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM g
"""
