"""Named queries over the provided tables, with the SQL that answers the same question."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return register


def steady_sql(sql: str) -> str:
    """The SQL form of ``steady``: every rounding of the text gets the same small offset."""
    from studyframe.functions.columns import NUDGE

    return sql.replace("round(", f"round({NUDGE!r}::DOUBLE + ")
