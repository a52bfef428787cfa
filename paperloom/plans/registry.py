"""Registry of queries and of the SQL that a second engine runs for the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperloom.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


TEXT_TABLES = {"documents", "pages", "conversations"}


class Tables:
    """Attribute access to the parquet tables of one folder.

    Text tables do a lot of work per row. A file with fewer row groups than the session has slots is spread over them; a
    table of many files is read as it is.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        df = self.spark.read.parquet(f"{self.path}/{name}.parquet")
        return spread(df) if name in TEXT_TABLES else df


def query(key: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``key``."""

    def add(fn):
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = lambda spark, path: fn(Tables(spark, path))
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return add
