"""The ledger engine's queries and SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import agg_q, geometry_q, io_q, ledger_q, parse_q, reconcile_q, scalar_q

MODULES = (reconcile_q, ledger_q, agg_q, scalar_q, parse_q, geometry_q, io_q)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for module in MODULES for name, run in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
