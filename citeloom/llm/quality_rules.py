"""Quality rules with a distribution-divergence verdict, in DataFrame functions only.

``text_counts`` makes one row of integer counts per document; ``quality_rules`` adds the verdict.

* Base: a document fails with fewer than ``MIN_WORDS`` words or if over half of its words stand in three-word
  windows that the text holds twice or more.
* Verdict: two histograms of a document are compared with references, one per language, which are the summed
  histograms of all documents of that language that pass the base rules: character classes (lower-case and other
  letters, capitals, digits, white space, ASCII punctuation) and common words (per language the listed words, and
  "other").  The Jensen-Shannon distance (base 2, so 0 to 1) to the reference of the document's language has to stay within
  ``MAX_CHAR_DISTANCE`` and ``MAX_WORD_DISTANCE``.  Guards: under ``GUARD_CHARS`` characters or ``GUARD_WORDS`` words the
  histogram says too little, and that comparison is skipped.

Nulls and empties: a null or blank text counts 0 everywhere and fails the base rules.  A document whose
language is null or has no reference is compared with the reference of all documents together.  With no reference (an
empty table or only failing documents) the verdict is the base verdict.  Repeated rows each get a row, and each counts in
the references; an empty table gives no rows.  A text of any length is counted whole, at about 40 bytes of memory a byte of it.
Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.common import documents, stash, words

MIN_WORDS = 50
GUARD_CHARS = 200
GUARD_WORDS = 80
MAX_CHAR_DISTANCE = 0.2
MAX_WORD_DISTANCE = 0.3

#: Common words by language, in order of the alphabet.
COMMON_WORDS = {
    "de": ["auf", "das", "dem", "den", "der", "die", "ein", "für", "im", "in", "ist", "mit", "nicht", "und", "von", "zu"],
    "en": ["a", "and", "as", "for", "in", "is", "of", "on", "that", "the", "to", "was", "with"],
    "es": ["como", "con", "de", "el", "en", "es", "la", "los", "para", "por", "que", "se", "un", "una", "y"],
    "fr": ["avec", "ce", "dans", "de", "est", "et", "il", "la", "le", "les", "pas", "pour", "que", "un", "une", "vous"],
}
WORDS = sorted({w for ws in COMMON_WORDS.values() for w in ws})
CHAR_BINS = ["c_letter", "c_upper", "c_digit", "c_space", "c_punct"]
WORD_BINS = [f"w_{i}" for i in range(len(WORDS))] + ["w_other"]


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the integer counts of each whole text; no shuffle.

    The window hashes are laid out as their own columns so that no lambda evaluates them again per element; documents
    without a repeated hash skip the sort.  The others' windows are sorted by hash and words, and compared by their words, so
    the count is exact whatever the hashes.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", "lang", text.alias("text"), words(F.col("text")).alias("ws"))
    hashed = base.select("*", F.transform("ws", lambda w: F.xxhash64(w)).alias("wh"))
    pairs = hashed.select("*", F.zip_with(F.expr("slice(wh, 1, greatest(size(wh) - 2, 0))"), F.expr("slice(wh, 2, greatest(size(wh) - 2, 0))"), lambda x, y: F.xxhash64(x, y)).alias("h2"))
    windows = pairs.select(
        "doc_id",
        "lang",
        "text",
        "ws",
        F.zip_with("h2", F.expr("slice(wh, 3, greatest(size(wh) - 2, 0))"), lambda x, y: F.xxhash64(x, y)).alias("hs"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.filter("ws", lambda w: F.lower(w).isin(WORDS)).alias("common"),
    )
    kept = ["doc_id", "lang", "text", "ws", "lines", "common"]
    window = lambda h, i: F.struct(h.alias("h"), F.get("ws", i).alias("a"), F.get("ws", i + 1).alias("b"), F.get("ws", i + 2).alias("c"), i.cast("long").alias("at"))
    ordered = windows.select(*kept, F.when(F.size(F.array_distinct("hs")) < F.size("hs"), F.sort_array(F.transform("hs", window))).alias("s"))
    same = lambda x, y: (x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
    repeated = ordered.select(*kept, F.when(F.col("s").isNotNull(), F.sort_array(F.transform(F.filter("s", lambda x, j: F.coalesce(same(F.get("s", j - 1), x), F.lit(False)) | F.coalesce(same(F.get("s", j + 1), x), F.lit(False))), lambda x: x["at"]))).alias("at"))
    covered = F.aggregate("at", F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("n")), lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3).cast("long"), x - a["last"])).alias("n")), lambda a: a["n"])
    code = F.create_map(*[F.lit(x) for i, w in enumerate(WORDS) for x in (w, chr(0x21 + i))])
    counted = repeated.select(
        "doc_id",
        "lang",
        F.size("ws").cast("long").alias("n_words"),
        F.length("text").cast("long").alias("n_text"),
        F.length(F.array_join("ws", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("c_upper"),
        F.regexp_count("text", F.lit("[0-9]")).cast("long").alias("c_digit"),
        F.regexp_count("text", F.lit(r"[!-/:-@\[-`{-~]")).cast("long").alias("c_punct"),
        # one character for each common word
        F.array_join(F.transform("common", lambda w: F.element_at(code, F.lower(w))), "").alias("common"),
    )
    bins = [(F.length("common") - F.length(F.replace("common", F.lit(chr(0x21 + i)), F.lit("")))).cast("long").alias(f"w_{i}") for i in range(len(WORDS))]
    return counted.select(
        *[c for c in counted.columns if c not in ("common", "n_text")],
        (F.col("n_text") - F.col("word_chars")).alias("c_space"),
        (F.col("word_chars") - F.col("c_upper") - F.col("c_digit") - F.col("c_punct")).alias("c_letter"),
        *bins,
        (F.col("n_words") - F.length("common")).cast("long").alias("w_other"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def language_references(counts: DataFrame) -> DataFrame:
    """Summed histograms of documents that pass the base rules, as shares: a row per language
    and one with a null language for all of them together."""
    sums = counts.where(~base_failed()).groupBy("lang").agg(*[F.sum(c).alias(c) for c in CHAR_BINS + WORD_BINS])
    kept = sums.where(F.col("lang").isNotNull()).select("lang", *CHAR_BINS, *WORD_BINS)
    pooled = sums.agg(*[F.sum(c).alias(c) for c in CHAR_BINS + WORD_BINS]).select(F.lit(None).cast("string").alias("lang"), *CHAR_BINS, *WORD_BINS)
    return kept.unionByName(pooled).select("lang", shares(CHAR_BINS).alias("ref_chars"), shares(WORD_BINS).alias("ref_words"))


def shares(bins: list[str]) -> Column:
    """The counts as an array of shares of their sum; null if all are 0."""
    counts = F.array(*[F.col(c).cast("double") for c in bins])
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.transform(counts, lambda x: x / total))


def js_distance(p: str, q: str) -> Column:
    """Square root of the Jensen-Shannon divergence (base 2) of two arrays of shares; null if either is null.

    With x ln x summed over p, q and p + q: JSD = (S(p) + S(q) - S(p + q)) / 2 + 1.
    """
    plogp = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: F.when(x > 0, a + x * F.log2(x)).otherwise(a))
    both = F.zip_with(p, q, lambda x, y: x + y)
    return F.sqrt(F.greatest((plogp(F.col(p)) + plogp(F.col(q)) - plogp(both)) / 2 + 1, F.lit(0.0)))


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance, word_distance."""
    counts = stash(text_counts(docs), "quality-counts")
    references = stash(language_references(counts), "quality-references")
    chars = F.col("c_space") + F.col("word_chars")
    plain = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    own = counts.select(*plain, "lang", base_failed().alias("base_failed"), F.when(chars >= GUARD_CHARS, shares(CHAR_BINS)).alias("chars"), F.when(F.col("n_words") >= GUARD_WORDS, shares(WORD_BINS)).alias("words"))
    by_lang = references.where(F.col("lang").isNotNull())
    pooled = references.where(F.col("lang").isNull()).select(F.col("ref_chars").alias("all_chars"), F.col("ref_words").alias("all_words"))
    # one small row per language: the join is chosen by size; the pooled reference is one row
    far = (
        own.join(by_lang, "lang", "left")
        .join(F.broadcast(pooled), F.lit(True), "left")
        .withColumn("ref_chars", F.coalesce("ref_chars", "all_chars"))
        .withColumn("ref_words", F.coalesce("ref_words", "all_words"))
        .select(*plain, "base_failed", js_distance("chars", "ref_chars").alias("char_distance"), js_distance("words", "ref_words").alias("word_distance"))
    )
    close = (F.coalesce(F.col("char_distance"), F.lit(0.0)) <= MAX_CHAR_DISTANCE) & (F.coalesce(F.col("word_distance"), F.lit(0.0)) <= MAX_WORD_DISTANCE)
    return far.select(*plain, "base_failed", (~F.col("base_failed") & close).alias("kept"), "char_distance", "word_distance")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


__all__ = ["base_failed", "language_references", "quality_rules", "text_counts"]
