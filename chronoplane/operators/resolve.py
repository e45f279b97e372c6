"""Entity resolution by a cascade of equi-joins, and the gates behind it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean_upper(c: Column) -> Column:
    return F.upper(F.trim(F.coalesce(c, F.lit(""))))


def active(asof: Column, start: str = "active_from", end: str = "active_to") -> Column:
    """Validity of a dated row; an empty bound is open."""
    return (F.col(start).isNull() | (F.col(start) <= asof)) & (F.col(end).isNull() | (asof <= F.col(end)))


def cascade(raw: DataFrame, steps: list[tuple[str, str, DataFrame, str]]) -> DataFrame:
    """Add instrument_id and source from the first step that matches.

    A step is (name, raw column, table of (key, instrument_id), key).  Keys are
    made unique first, so a row never multiplies.
    """
    out, found = raw, []
    for i, (_, column, table, key) in enumerate(steps):
        unique = table.groupBy(F.col(key).alias(f"_k{i}")).agg(F.min("instrument_id").alias(f"_id{i}"))
        out = out.join(unique, (F.col(column) == F.col(f"_k{i}")) & (F.col(column) != ""), "left")
        found.append(f"_id{i}")
    source = reduce(lambda acc, i: acc.when(F.col(found[i]).isNotNull(), F.lit(steps[i][0])), range(1, len(steps)), F.when(F.col(found[0]).isNotNull(), F.lit(steps[0][0])))
    return out.withColumn("instrument_id", F.coalesce(*found)).withColumn("source", source.otherwise("unresolved")).drop(*found, *[f"_k{i}" for i in range(len(steps))])


def store_gate(weights: DataFrame, members: DataFrame, by: str, key: str, weight: str) -> DataFrame:
    """Per group: whether all weighted keys are members and the weights sum to one."""
    stray = weights.join(members, [by, key], "left_anti").groupBy(by).agg(F.count(F.lit(1)).alias("n_stray"))
    out = weights.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("total")).join(stray, by, "left").na.fill(0, ["n_stray"])
    return out.withColumn("open", (F.col("n_stray") == 0) & F.col("total").between(0.99, 1.01))
