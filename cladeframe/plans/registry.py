"""All queries of the library's own operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cladeframe.plans import ancestor_queries, factor_queries, graph_queries, interval_queries, mixture_queries, model_queries, network_queries, numeric_queries, search_queries, statistics_queries, structure_queries, table_queries, tree_queries

_MODULES = (factor_queries, interval_queries, statistics_queries, numeric_queries, table_queries, tree_queries, graph_queries, structure_queries, search_queries, ancestor_queries, network_queries, model_queries, mixture_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factor_queries.QUERIES["factor_posterior"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.ORACLE_SQL.items()}
