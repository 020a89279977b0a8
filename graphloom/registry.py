"""All queries of the program-graph operators by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def load() -> None:
    """Imports the modules that register queries; here, and not above, as they import this one."""
    from graphloom.operators import checker_queries, format_queries, graph_queries, interproc_queries, view_queries  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    load()
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the call graph: scan, filter, aggregations, closure and sort."""
    return queries()["metric_flags"](spark, sf_dir).orderBy(F.desc("in_deg"), "fn")
