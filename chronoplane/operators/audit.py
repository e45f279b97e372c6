"""Audits of keyed histories: vintages, regimes, transitions, coverage, tails."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoplane.operators.ranking import quantiles

TOLERANCE = 1e-12


def latest_per_key(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The values of the last row per key; partial maxima replace a sort."""
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("v"))
    return last.select(*keys, "v.*")


def is_material(delta: Column, limit: float = 0.05) -> Column:
    """Whether a change exceeds the limit; the limit itself doesn't."""
    return F.coalesce(F.abs(delta) > limit + TOLERANCE, F.lit(False))


def runs(df: DataFrame, key: str, order: list[str], label: str) -> DataFrame:
    """Maximal stretches of equal labels: (key, run, label, start, finish, steps)."""
    by = Window.partitionBy(key).orderBy(*order)
    changed = F.when(F.row_number().over(by) == 1, 1).when(F.col(label).eqNullSafe(F.lag(label).over(by)), 0).otherwise(1)
    marked = df.withColumn("_c", changed).withColumn("run", F.sum("_c").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "run").agg(F.first(label).alias(label), F.min(order[0]).alias("start"), F.max(order[0]).alias("finish"), F.count(F.lit(1)).alias("steps"))


def durations(stretches: DataFrame, label: str) -> DataFrame:
    return stretches.groupBy(label).agg(F.count(F.lit(1)).alias("n_runs"), F.min("steps").alias("shortest"), F.median("steps").alias("median"), F.avg("steps").alias("mean"), F.max("steps").alias("longest"))


def transitions(df: DataFrame, key: str, order: list[str], label: str) -> DataFrame:
    """Pairs of consecutive labels, changes and stays."""
    by = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("from_label", F.lag(label).over(by)).withColumn("to_label", F.col(label)).where("from_label IS NOT NULL")


def transition_matrix(df: DataFrame, key: str, order: list[str], label: str, labels: list[str]) -> DataFrame:
    """Counts of transitions, a row per origin and a column per destination."""
    pairs = transitions(df, key, order, label)
    return pairs.groupBy("from_label").pivot("to_label", labels).agg(F.count(F.lit(1))).na.fill(0)


def event_response(df: DataFrame, key: str, order: list[str], label: str, value: str) -> DataFrame:
    """Mean value before and after each kind of change."""
    by = Window.partitionBy(key).orderBy(*order)
    moved = transitions(df.withColumn("_pre", F.lag(value).over(by)), key, order, label).where("from_label <> to_label")
    return moved.groupBy("from_label", "to_label").agg(F.count(F.lit(1)).alias("n_events"), F.avg("_pre").alias("pre"), F.avg(value).alias("post"), F.avg(F.col(value) - F.col("_pre")).alias("delta"))


def compressed_sequence(stretches: DataFrame, key: str, label: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("run", label)))
    return stretches.groupBy(key).agg(F.array_join(F.transform(ordered, lambda s: s[label]), " -> ").alias("sequence"))


def strict_epoch(df: DataFrame, key: str, day: str, eligible: str) -> DataFrame:
    """The earliest day from which every later one is eligible: the day after the last failure."""
    ends = df.groupBy(key).agg(F.max(F.when(~F.col(eligible), F.col(day))).alias("_bad"))
    return df.join(ends, key).where(F.col("_bad").isNull() | (F.col(day) > F.col("_bad"))).groupBy(key).agg(F.min(day).alias("epoch"), F.count(F.lit(1)).alias("n_days"))


def extremes(df: DataFrame, by: list[str], value: str, k: int) -> DataFrame:
    """The k largest and smallest rows; both limits run per partition before they meet."""
    top = df.orderBy(F.desc(value), *by).limit(k).withColumn("side", F.lit("top"))
    return top.unionByName(df.orderBy(F.asc(value), *by).limit(k).withColumn("side", F.lit("bottom")))


def nth_known(df: DataFrame, key: str, order: str, value: str, n: int) -> DataFrame:
    """The place of the n-th known value of each key."""
    by = Window.partitionBy(key).orderBy(order)
    return df.where(F.col(value).isNotNull()).withColumn("_i", F.row_number().over(by)).where(F.col("_i") == n).select(key, F.col(order).alias("boundary"))


def distribution(df: DataFrame, by: str, value: str) -> DataFrame:
    """Known values and five exact quantiles per group; a group without a known value has none of either."""
    known = quantiles(df, [by], value, {f"p{round(100 * s):02d}": s for s in (0.01, 0.05, 0.5, 0.95, 0.99)})
    every = df.select(F.col(by).alias("_by")).distinct()
    out = every.join(known, F.col("_by").eqNullSafe(F.col(by)), "left")
    return out.select(F.col("_by").alias(by), F.coalesce("n", F.lit(0)).alias("n"), *known.columns[2:])


def sensitivity(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Two sources side by side, rows of either kept."""
    left, right = a.select(*keys, F.col(value).alias(f"{value}_a")), b.select(*keys, F.col(value).alias(f"{value}_b"))
    return left.join(right, keys, "full_outer")


def spliced(primary: DataFrame, supplement: DataFrame, keys: list[str]) -> DataFrame:
    """The primary source, completed by rows of the supplement for keys it lacks."""
    return primary.unionByName(supplement.join(primary, keys, "left_anti"))


def missing_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Known and null counts per column, a row each."""
    counts = df.agg(*[F.count(c).alias(c) for c in columns], F.count(F.lit(1)).alias("_n"))
    parts = [counts.select(F.lit(c).alias("column_name"), F.col(c).alias("n_known"), (F.col("_n") - F.col(c)).alias("n_null")) for c in columns]
    return reduce(DataFrame.unionByName, parts)
