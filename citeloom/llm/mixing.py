"""Mixing sources to target weights with Efraimidis-Spirakis sampling.

Sources in code-point order (null last) weigh 5, 2, 1, repeating, and share all words between them; no target exceeds
``MAX_EPOCHS`` times the words of its source, and what is cut there is shared among the others by weight.  A source's
target is met with complete epochs of all its documents first; for the rest, documents are taken in the order of the
exponential key ``-ln(u) / weight`` (u: keyed hash of doc_id, weight: the document's quality weight) while their
running sum of words is nearest to what is left.

The running sums need no task that holds a source: the logarithm of the key, as a 48-bit number, falls into ``BINS`` bins;
sums per (source, bin) are added up, and the one bin per source where the rest runs out is binned again until it holds at
most ``SORT_ROWS`` different documents.  Only these are put in order.

Null texts have size 0 and are never taken; a null source is a source of its own, the last; a null doc_id is drawn by the
text's checksum.  Equal keys go by doc_id, then the text's md5.  Repeated rows count one by one: the rest may take
some of them and not others, whichever they are, since they are alike.  An empty table gives an empty result.  A text of any
length is one row.  Extra columns are ignored by ``mix`` and kept by ``mixed_documents``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.llm.common import documents, drop_stash, n_words, renamed, stash

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
SEED = "mix-1"
BITS, BIN_BITS = 48, 12
BINS = 1 << BIN_BITS
SORT_ROWS = 4096


def keys(seed: str = SEED) -> Column:
    """For a row with doc_id and text: size, weight, key, doc_id and text_md5.

    The weight falls from 1 as the mean length of words leaves that of prose.
    """
    size, sum_ = n_words(F.col("text")), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    off = ((F.length("text") - size) / size - 5.0) / 5.0
    weight = F.when(size > 0, 1.0 / (1.0 + off * off)).otherwise(F.lit(1.0))
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit(":"), sum_))
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), name).cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return F.struct(size.alias("size"), weight.alias("weight"), (-F.log(u) / weight).alias("key"), F.col("doc_id").alias("doc_id"), sum_.alias("text_md5"))


def targets(keyed: DataFrame) -> DataFrame:
    """source, source_size, target: a row per source.

    With a source's limit and weight, every target is min(limit, level * weight) for the one level at which all words
    are shared; sources in the order of limit / weight give the level in one pass.
    """
    by_source = keyed.groupBy("source").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*[F.lit(w) for w in WEIGHTS])
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = by_source.withColumn("w", F.get(cycle, (F.row_number().over(order) - 1) % len(WEIGHTS))).withColumn("limit", F.lit(float(MAX_EPOCHS)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    level = (
        weighed.withColumn("before", F.coalesce(F.sum("limit").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("w").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("all", F.sum("source_size").over(everything))
        .withColumn("here", (F.col("all") - F.col("before")) / F.col("open"))
        .withColumn("level", F.min(F.when(F.col("here") <= F.col("limit") / F.col("w"), F.struct((F.col("limit") / F.col("w")).alias("r"), F.col("here")))).over(everything)["here"])
    )
    return level.select("source", "source_size", F.least(F.col("limit"), F.col("level") * F.col("w")).alias("target"))


def _place(key: Column) -> Column:
    """A number of ``BITS`` bits that does not fall as the key grows; logarithms of keys lie between -64 and 64."""
    return F.floor((F.log(key) + 64.0) / 128.0 * float(1 << BITS)).cast("long")


def cutoffs(keyed: DataFrame) -> DataFrame:
    """A row per source: source_size, target, epochs, and where the fractional selection ends: at the documents ``cut``
    (key, doc_id, text_md5), of whose equal rows ``some`` are taken and all documents before them."""
    rest = targets(keyed).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    rest = stash(rest.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-rest")
    # equal rows as one, with their number
    groups = keyed.where("size > 0").groupBy("source", "key", "doc_id", "text_md5", "size").agg(F.count(F.lit(1)).alias("times"))
    inside = stash(groups.withColumn("z", _place(F.col("key"))), "mix-groups")
    first = inside
    edge = rest.select(F.col("source").alias("of"), "rest", F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("before"))
    run = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    old: list[DataFrame] = []
    for shift in range(BITS - BIN_BITS, -1, -BIN_BITS):
        here = inside.join(edge.withColumnRenamed("bin", "outer"), F.col("source").eqNullSafe(F.col("of")) & (F.shiftright("z", shift + BIN_BITS) == F.col("outer")))
        sums = here.groupBy("source", "rest", "before", F.shiftright("z", shift).alias("bin")).agg(F.sum(F.col("size") * F.col("times")).alias("words"), F.count(F.lit(1)).alias("rows"))
        sums = sums.withColumn("start", F.col("before") + F.coalesce(F.sum("words").over(run), F.lit(0)))
        found = stash(sums.where((F.col("start") <= F.col("rest")) & (F.col("rest") < F.col("start") + F.col("words"))).select(F.col("source").alias("of"), "rest", "bin", F.col("start").alias("before"), "rows"), "mix-edge")
        most = found.agg(F.max("rows")).first()[0]
        old.append(found)
        edge = found.drop("rows")
        if (most or 0) <= SORT_ROWS:
            break
    here = inside.join(edge, F.col("source").eqNullSafe(F.col("of")) & (F.shiftright("z", shift) == F.col("bin")))
    order = Window.partitionBy("source").orderBy("key", "doc_id", "text_md5").rowsBetween(Window.unboundedPreceding, -1)
    words = F.col("size") * F.col("times")
    summed = here.withColumn("p", F.col("before") + F.coalesce(F.sum(words).over(order), F.lit(0)))
    # a row is taken if the rest reaches its middle; the selection ends at the first group of which a row is not taken, or
    # after the last group of the bin
    summed = summed.withColumn("some", F.least(F.greatest(F.floor((F.col("rest") - F.col("p")) / F.col("size") + 0.5), F.lit(0)), F.col("times")).cast("long"))
    group = F.struct("key", "doc_id", "text_md5", "some")
    ends = summed.groupBy("source").agg(F.coalesce(F.min(F.when(F.col("some") < F.col("times"), group)), F.max(group)).alias("cut"))
    out = stash(rest.alias("r").join(ends.alias("e"), F.expr("r.source <=> e.source"), "left").select("r.source", "r.source_size", "r.target", "r.epochs", F.struct("e.cut.key", "e.cut.doc_id", "e.cut.text_md5").alias("cut"), F.col("e.cut.some").alias("some"), F.col("e.cut").isNotNull().alias("ends")), "mix-cutoffs")
    drop_stash(rest, first, *old)
    return out


def _with_copies(rows: DataFrame, columns: list[str], row: str, end: str, copies: str) -> DataFrame:
    """``columns``, ``row``, ``end`` and the number of copies of each row, from rows with structs ``row`` (``keys``) and ``end``."""
    own, cut = F.struct(f"{row}.key", f"{row}.doc_id", f"{row}.text_md5"), F.col(f"{end}.cut")
    some_left = (F.col(f"{row}.size") > 0) & F.col(f"{end}.ends")
    at_cut, before = some_left & own.eqNullSafe(cut), some_left & (own < cut)
    names = [*columns, row, end]
    plain = rows.where(~at_cut).select(*names, F.when(F.col(f"{row}.size") > 0, F.col(f"{end}.epochs") + before.cast("long")).otherwise(F.lit(0)).cast("long").alias(copies))
    # equal rows at the cut: numbered inside each partition, and from one to the next by the partitions' counts
    number, part, offset, of, at = renamed(["_number", "_part", "_offset", "_of", "_at"], names)
    group = [F.col(f"{row}.{c}") for c in ("key", "doc_id", "text_md5")]
    parted = rows.where(at_cut).select(*names, F.spark_partition_id().alias(part))
    cut_rows = stash(parted.withColumn(number, F.row_number().over(Window.partitionBy(part, f"{end}.source").orderBy(*group))), "mix-cut")
    counts = cut_rows.groupBy(F.col(f"{end}.source").alias(of), F.col(part).alias(at)).agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select(of, at, F.coalesce(F.sum("n").over(Window.partitionBy(of).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(offset))
    numbered = cut_rows.join(offsets, F.col(f"{end}.source").eqNullSafe(F.col(of)) & (F.col(part) == F.col(at)))
    some = numbered.select(*names, (F.col(f"{end}.epochs") + (F.col(number) + F.col(offset) <= F.col(f"{end}.some")).cast("long")).alias(copies))
    return plain.union(some)


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, weight for every row."""
    keyed = stash(docs.select("source", keys(seed).alias("k")).select("source", "k.*"), "mix-keys")
    ends = cutoffs(keyed)
    rows = keyed.alias("k").join(ends.alias("e"), F.expr("k.source <=> e.source")).select(F.struct("k.size", "k.weight", "k.key", "k.doc_id", "k.text_md5").alias("row"), F.struct("e.*").alias("end"))
    both = _with_copies(rows, [], "row", "end", "copies")
    return both.select("row.doc_id", "row.size", "end.source_size", "end.target", (F.col("row.size") * F.col("copies")).alias("taken"), "row.weight")


def mixed_documents(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The rows of the mix, each as often as it is taken, copies one after another."""
    row, end, copies, times = renamed(["_row", "_end", "_copies", "_times"], docs.columns)
    keyed = stash(docs.select("source", keys(seed).alias("k")).select("source", "k.*"), "mix-keys")
    ends = cutoffs(keyed).select(F.struct("*").alias(end))
    drop_stash(keyed)
    rows = docs.select("*", keys(seed).alias(row)).join(ends, F.col("source").eqNullSafe(F.col(f"{end}.source")))
    taken = _with_copies(rows, docs.columns, row, end, copies).where(F.col(copies) > 0)
    return taken.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, text, md5(coalesce(text, '')) AS text_md5, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), k AS (
  SELECT *, CASE WHEN size > 0 THEN 1.0::DOUBLE / (1.0::DOUBLE + power((((length(text) - size)::DOUBLE / size) - 5.0::DOUBLE) / 5.0::DOUBLE, 2)) ELSE 1.0::DOUBLE END AS weight,
    (('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), ':' || text_md5)), 1, 12))::BIGINT::DOUBLE + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM d
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source
), w AS (
  SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w, 3.0::DOUBLE * source_size AS lim FROM s
), l AS (
  SELECT *, lim / w AS r, ((SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(lim) OVER (ORDER BY lim / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) /
    sum(w) OVER (ORDER BY lim / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS here FROM w
), t AS (
  SELECT source, source_size, least(lim, w * (SELECT here FROM l WHERE here <= r ORDER BY r LIMIT 1)) AS target FROM l
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t
), p AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, k.weight, e.target - e.epochs * e.source_size AS rest,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY -ln(k.u) / k.weight, k.doc_id NULLS FIRST, k.text_md5 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE WHEN before + size / 2.0 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken, weight FROM p
"""
