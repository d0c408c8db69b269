"""Registry of the credit-risk queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import credit, fitted, oracles, surface


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credit.woe_merged(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (*credit.WITH_ORACLE, *credit.ROWS_ONLY, *surface.QUERIES, *fitted.QUERIES)}


def oracle_sql() -> dict[str, str]:
    return oracles.all_sql() | surface.oracle_sql()
