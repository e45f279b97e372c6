"""A catalogue of queries: each has a Spark function and DuckDB SQL for its check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOGUE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) -> DataFrame under ``name``."""

    def put(f):
        CATALOGUE[name] = f, sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def neat(c: Column | str, digits: int = 6) -> Column:
    """A result rounded for comparison between engines, without negative zero."""
    return F.round(c, digits) + F.lit(0.0)
