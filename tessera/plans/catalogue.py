"""Registered queries over the test tables, with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import array_queries, profile_queries, relational_queries

_MODULES = (relational_queries, profile_queries, array_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational_queries.flagship(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
