"""The named queries of the library and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from prosewright.plans import analysis_queries, model_queries, report_queries, rule_queries

MODULES = (analysis_queries, rule_queries, model_queries, report_queries)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade of layers over all documents."""
    return model_queries.cascade_all(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
