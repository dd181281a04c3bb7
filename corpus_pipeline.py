"""A training-corpus pipeline over ``documents``: identify languages, drop junk, drop near-copies, mix sources, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``.  All but the last return the columns of ``documents``, extra ones with them, whatever their names.  An empty
table passes every stage empty.  Nulls, ties, repeated rows and long texts are treated as each operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm import language_id, mixing, ngram_join, piece_encoding, quality_classifier
from citeloom.llm.common import documents, drop_stash, renamed, ship, stash

#: A document goes if no language is found, or if none gets at least this score.
MIN_LANGUAGE_SCORE = 0.5
#: A document goes if its quality score is below this.
MIN_QUALITY_SCORE = 0.3


def _kept(scored: DataFrame, docs: DataFrame, added: list[str]) -> DataFrame:
    """The columns of ``docs`` again, under their own names."""
    return scored.select(*[F.col(new).alias(old) for new, old in zip(renamed(docs.columns, added), docs.columns, strict=True)])


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; null, empty and letterless texts go."""
    ship(spark)
    scored = language_id.identify(docs, language_id.learn(docs), docs.columns)
    return _kept(scored.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SCORE)), docs, ["lang_pred", "score"])


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    ship(spark)
    net = quality_classifier.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality_classifier.score_quality(docs, net, docs.columns)
    return _kept(scored.where(F.col("score") >= MIN_QUALITY_SCORE), docs, ["score"])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents, that of the smallest doc_id (of several, the least class); of equal
    rows, one.  A doc_id that stands for several texts keeps those that no document of a smaller doc_id is linked with."""
    ship(spark)
    return ngram_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; its copies stand one after another."""
    ship(spark)
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, lossless, ids.  Copies of a document are segmented apart."""
    ship(spark)
    return piece_encoding.encode_pieces(docs, apart=True)


STAGES = [
    ("language_id", identify_languages),
    ("quality_classifier", classify_quality),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("piece_encoding", encode),
]

#: Learned models and keyed hashes have no SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        after = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            drop_stash(before)
        docs = before = after
    return STAGES[-1][1](spark, docs, sf_dir)
