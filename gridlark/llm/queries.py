"""The registered queries of this subpackage and the SQL that they can be held against."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query name -> module of this package that has it.
WHERE = {
    "op1_lm_score": "lm_score",
    "op2_quality_classifier": "quality",
    "op3_order_minhash": "order_minhash",
    "op4_simhash_covering": "covering",
    "op6_flac_media": "flac",
    "op7_token_counts": "token_counts",
    "op10_language_id": "langid",
    "op9_suffix_dedup": "suffix_dedup",
    "op8_source_mixing": "mixing",
    "op5_packing": "packing",
}


def _lazily(module: str, name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return getattr(import_module(f"gridlark.llm.{module}"), name)(spark, sf_dir)

    run.__name__ = name
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _lazily(module, name) for name, module in WHERE.items()}


def oracle_sql() -> dict[str, str]:
    return {}
