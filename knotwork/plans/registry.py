"""Registration of queries, and what many of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from knotwork.operators.graph import content_only, current_edges, current_nodes
from knotwork.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: The time at which queries look at the graph. Fixed value.
AS_OF = "2025-07-01 00:00:00"

NODES = """n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, node_id
 ORDER BY last_accessed_at DESC NULLS LAST, access_count DESC NULLS LAST) AS rn FROM nodes) WHERE rn = 1)"""
DIRECTED = "d AS (SELECT DISTINCT * FROM directed_edges)"
UNDIRECTED = "u AS (SELECT DISTINCT * FROM undirected_edges)"


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def graph_nodes(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return current_nodes(table(spark, sf, "nodes"), *columns)


def content_nodes(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return content_only(graph_nodes(spark, sf, *columns))


def directed(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return current_edges(table(spark, sf, "directed_edges"), *columns)


def undirected(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return current_edges(table(spark, sf, "undirected_edges"), *columns)
