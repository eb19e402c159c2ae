"""Registry of the queries over the driver tables, each with its DuckDB oracle.

A query is ``fn(spark, sf_dir) -> DataFrame``.  ``sql`` is the equivalent
ANSI SQL over the pre-registered views (``None`` = rows-only check).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass
class Query:
    name: str
    fn: QueryFn
    sql: str | None
    operators: str


_QUERIES: dict[str, Query] = {}


def query(name: str, operators: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = Query(name, fn, sql, operators)
        return fn
    return deco


def all_queries() -> dict[str, Query]:
    # Importing the plan modules registers their queries.
    from tesserae.plans import (chat, corpus, files, inference, logits,  # noqa: F401
                                scoring, tokens)
    return dict(_QUERIES)


_TABLES: dict[tuple[str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The driver table as a DataFrame.  The relation (file listing and
    schema, not data) is reused within one application; the driver tables
    are read-only."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    df = _TABLES.get(key)
    if df is None or df.sparkSession is not spark:
        df = spark.read.parquet(path)
        _TABLES[key] = df
    return df
