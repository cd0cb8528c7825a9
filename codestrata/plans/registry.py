"""All queries and their SQL, without those of the llm subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codestrata.plans import churn_queries, code_queries, data_queries, graph_queries, ingest_queries, language_queries, memory_queries, scoring_queries, streaming_queries, support_queries

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = [churn_queries, memory_queries, ingest_queries, graph_queries, scoring_queries, language_queries, code_queries, streaming_queries, data_queries, support_queries]


def queries() -> dict[str, Query]:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.ORACLE.items()}
