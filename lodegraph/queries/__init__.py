"""The queries of the core package and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodegraph.queries import graph, problems, references, resolution, search, tables, upkeep

Query = Callable[[SparkSession, str], DataFrame]
MODULES = [problems, tables, graph, search, resolution, references, upkeep]


def queries() -> dict[str, Query]:
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
