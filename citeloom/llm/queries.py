"""Registered queries of the training-data operators: each applies its operator to the whole tables."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from citeloom.llm.common import ship

#: query name -> module and function of this subpackage; each function takes (spark, sf_dir)
REGISTERED = {
    "op1_quality_classifier": ("quality_classifier", "query"),
    "op2_ngram_join": ("ngram_join", "query"),
    "op3_language_id": ("language_id", "query"),
    "op4_toxicity": ("toxicity", "query"),
    "op5_piece_encoding": ("piece_encoding", "query"),
    "op6_topk_search": ("topk_search", "query"),
    "op7_token_counts": ("token_counts", "query"),
    "op8_quality_rules": ("quality_rules", "query"),
    "op10_token_output": ("token_output", "query"),
    "op9_mixing": ("mixing", "query"),
    "op11_minhash_forest": ("minhash_forest", "query"),
    "op12_hard_negatives": ("hard_negatives", "query"),
    "op13_filter_audit": ("filter_audit", "query"),
}


def _call(module: str, function: str) -> Callable[[SparkSession, str], DataFrame]:
    run = getattr(importlib.import_module(f"citeloom.llm.{module}"), function)

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return run(spark, sf_dir)

    return query


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _call(*where) for name, where in REGISTERED.items()} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"citeloom.llm.{module}"), "ORACLE_SQL", None) for name, (module, _) in REGISTERED.items()}
    return {name: sql for name, sql in found.items() if sql}
