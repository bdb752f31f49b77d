"""The operator queries, each loaded when it is first run."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query name: (module, function, name of its SQL in the module or None).
TABLE = {
    "op1_suffix_dedup": ("suffix_dedup", "query", None),
    "op2_html_text": ("html_text", "query", None),
    "op3_source_mixing": ("mixing", "query", None),
    "op4_minhash_near_dedup": ("minhash", "query", "SQL"),
    "op5_embedding_dedup": ("embedding_dedup", "query", "SQL"),
    "op6_pii": ("pii", "query", None),
    "op7_toxicity": ("toxicity", "query", None),
    "op8_nearest": ("nearest", "query", None),
    "op9_packing": ("packing", "query", None),
    "op10_kneser_ney": ("kneser_ney", "query", None),
}


def _runner(module: str, function: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: getattr(import_module(f"siltstone.llm.{module}"), function)(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _runner(module, function) for name, (module, function, _) in TABLE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(import_module(f"siltstone.llm.{module}"), sql) for name, (module, _, sql) in TABLE.items() if sql}
