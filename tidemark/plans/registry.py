"""All queries of the core by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import flow_queries, graph_queries, ledger_queries, link_queries, problems, review_queries, search_queries, store_queries, text_queries

MODULES = (problems, graph_queries, text_queries, link_queries, ledger_queries, flow_queries, review_queries, store_queries, search_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for m in MODULES for name, s in m.SQL.items()}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return problems.p1_found(spark, d)
