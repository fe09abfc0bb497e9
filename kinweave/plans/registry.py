"""The registered queries by name, and DuckDB SQL of the same results where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Put a query under its name, with SQL if there is some; a name is given once."""

    def put(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder as it is."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
