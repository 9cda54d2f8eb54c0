"""Where queries are entered: name -> (spark, sf_dir) -> DataFrame, and name -> SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Enter a function of a table reader, t(name) -> DataFrame, under its own name."""

    def enter(build):
        if build.__name__ in QUERIES:
            raise ValueError(f"two queries are named {build.__name__}")
        QUERIES[build.__name__] = lambda spark, sf_dir: build(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            ORACLE_SQL[build.__name__] = sql
        return build

    return enter
