"""Replays under changed inputs: all scenarios in one pass, compared with the base."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = "base"


def exploded(df: DataFrame, key: str, changes: dict[str, dict[str, Column]]) -> DataFrame:
    """The rows once as they are and once per scenario, whose columns are replaced; key becomes (key, scenario).

    ``changes`` maps a scenario to its replaced columns.  The new column ``run``
    is the key of a replay; ``scenario`` and the old key stay.
    """
    if BASE in changes:
        raise ValueError(f"{BASE} is the name of the unchanged rows")
    names = [BASE, *changes]
    rows = df.withColumn("scenario", F.explode(F.array(*map(F.lit, names))))
    touched = list(dict.fromkeys(c for own in changes.values() for c in own))
    for c in touched:
        value = F.col(c)
        for name, own in changes.items():
            if c in own:
                value = F.when(F.col("scenario") == name, own[c]).otherwise(value)
        rows = rows.withColumn(f"_new_{c}", value)
    rows = rows.drop(*touched).withColumnsRenamed({f"_new_{c}": c for c in touched})
    return rows.withColumn("run", F.concat_ws("|", F.col("scenario"), F.col(key).cast("string")))


def replayed(df: DataFrame, key: str, order: str, changes: dict[str, dict[str, Column]], chain: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The results of ``chain(rows, key of a run)`` for the base and all scenarios, with key and scenario."""
    rows = exploded(df, key, changes)
    runs = rows.select("run", "scenario", key).distinct()
    made = chain(rows, "run")
    return made.join(runs, "run").drop("run")


def differences(results: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Per scenario and row, how far each column is from the base: ``d_<column>``, null where either is missing."""
    base = results.where(F.col("scenario") == BASE).select(key, order, *[F.col(c).alias(f"_b_{c}") for c in columns])
    others = results.where(F.col("scenario") != BASE)
    met = others.join(base, [key, order], "left")
    return met.select("scenario", key, order, *[(F.col(c) - F.col(f"_b_{c}")).alias(f"d_{c}") for c in columns])


def sensitivity_summary(diffs: DataFrame, columns: list[str]) -> DataFrame:
    """Per scenario: rows compared, mean and largest absolute difference of each column."""
    out = []
    for c in columns:
        d = F.abs(F.col(f"d_{c}"))
        out += [F.count(d).alias(f"n_{c}"), F.avg(d).alias(f"mean_abs_{c}"), F.max(d).alias(f"max_abs_{c}")]
    return diffs.groupBy("scenario").agg(*out)
