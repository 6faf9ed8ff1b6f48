"""Registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

PLAIN = {"tinyint": "bigint", "smallint": "bigint", "int": "bigint", "float": "double", "date": "string"}


def plain_types(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint, numbers as double, dates as text: the same types in both engines."""
    casts = {}
    for name, kind in df.dtypes:
        target = "double" if kind.startswith("decimal") else PLAIN.get(kind)
        if target:
            casts[name] = F.col(name).cast(target)
    return df.withColumns(casts) if casts else df


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL it is checked against if there is one."""

    def register(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        @wraps(run)
        def typed(spark: SparkSession, folder: str) -> DataFrame:
            return plain_types(run(spark, folder))

        QUERIES[name] = typed
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register
