"""The queries of this subpackage and the SQL that gives the same rows, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_WHERE = {
    "op1_best_fit_packing": "packing",
    "op2_ftrl_toxicity": "toxicity",
    "op3_induced_suffix_dedup": "suffixdedup",
    "op4_setsketch_near_dedup": "near",
    "op5_va_file_topk": "topk",
    "op6_weak_supervision": "rules",
    "op7_histogram_sharding": "sharding",
    "op8_warc_index_first": "warc",
    "op9_subset_sum_mixing": "mixing",
    "op10_fourier_quality": "quality",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"textloom.llm.{module}"), name) for name, module in _WHERE.items()}


def oracle_sql() -> dict[str, str]:
    from textloom.llm.near import OP4_SQL
    from textloom.llm.topk import OP5_SQL
    from textloom.llm.warc import OP8_SQL

    return {"op4_setsketch_near_dedup": OP4_SQL, "op5_va_file_topk": OP5_SQL, "op8_warc_index_first": OP8_SQL}
