"""All queries of the library: (spark, dataset folder) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.jobs import auditing, counting, following, measuring, reading, revalidating, tracking

Query = Callable[[SparkSession, str], DataFrame]

#: Date columns of query results; results give them as text, which every reader sees alike.
DATES = {
    "op_latest": ["run_date"],
    "op_history": ["run_date"],
    "op_bridges_owed": ["since"],
    "op_daily_checks": ["day"],
    "op_gap_causes": ["day"],
    "op_recent_activity": ["day"],
    "op_due_jobs": ["last_run"],
    "op_alarms_since": ["run_date"],
    "op_baselines": ["day"],
}


def _plain(name: str, query: Query) -> Query:
    if name not in DATES:
        return query

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return query(spark, folder).withColumns({c: F.col(c).cast("string") for c in DATES[name]})

    return run


def _plain_sql(name: str, sql: str) -> str:
    if name not in DATES:
        return sql
    return "SELECT * REPLACE (" + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in DATES[name]) + f") FROM ({sql}) plain_dates"


_MODULES = (counting, tracking, reading, auditing, measuring, following, revalidating)
QUERIES: dict[str, Query] = {k: _plain(k, q) for m in _MODULES for k, q in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: _plain_sql(k, s) for m in _MODULES for k, s in m.SQL.items()}
