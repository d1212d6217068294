"""Queries and SQL of the training-data operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, decontaminate, language_id, near_dups, packing, pii, quality_knn, quality_rules, suffix_dedup, toxicity

MODULES = (near_dups, language_id, quality_knn, decontaminate, packing, toxicity, chat_format, suffix_dedup, pii, quality_rules)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for module in MODULES for name, run in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
