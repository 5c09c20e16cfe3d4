"""Where queries and their SQL register themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"two queries are called {key}")
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return put


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
