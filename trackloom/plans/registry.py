"""Named queries over the test tables, each with DuckDB SQL for the same rows where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name -> query(spark, sf_dir)
QUERIES: dict = {}
#: name -> DuckDB SQL
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Registers a query and its SQL."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


from trackloom.plans import catalogue, forecasts, products, assembly  # noqa: E402, F401  registers the queries
