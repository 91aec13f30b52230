"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("op1_toxicity", "op2_lm_scoring", "op3_bpe", "op4_decontamination", "op5_near_dedup", "op6_quality_rules", "op7_license_scans", "op8_suffix_dedup", "op9_secret_scans", "op10_sharding")
SQL: dict[str, str] = {}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(importlib.import_module(f"tidemark.llm.{name}"), name) for name in MODULES}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
