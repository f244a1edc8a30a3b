"""The queries of this subpackage: ``QUERIES`` and, where SQL can express them, ``ORACLE``."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = {
    "op1_url_filter": "url_filter",
    "op2_packing": "packing",
    "op3_simhash": "simhash",
    "op4_pii": "pii",
    "op5_byte_bpe": "byte_bpe",
    "op6_ann": "ann",
    "op7_suffix_dedup": "exact_substrings",
    "op8_quality": "quality",
    "op9_toxicity": "toxicity",
    "op10_language": "language",
    "op11_collocations": "phrases",
    "op12_filter_audit": "filter_audit",
    "op13_best_fit": "best_fit",
}


def _query(module: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: importlib.import_module(f"webloom.llm.{module}").query(spark, sf_dir)


QUERIES = {name: _query(module) for name, module in MODULES.items()}


def oracle() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"webloom.llm.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
