"""The registered queries over the driver's tables, and their SQL.

Queries run over whole tables; figures are rounded alike on both sides, for sums of doubles depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terrane.plans import queries_clusters, queries_facts, queries_sources, queries_spatial

Query = Callable[[SparkSession, str], DataFrame]


def _all() -> dict[str, tuple[Query, str | None]]:
    return queries_facts.QUERIES | queries_clusters.QUERIES | queries_spatial.QUERIES | queries_sources.QUERIES


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
