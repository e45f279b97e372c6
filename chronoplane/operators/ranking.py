"""Ranks and exact quantiles of large groups, by ranges of values instead of one ordered task.

Values are counted first.  The distinct ones are cut into ranges at approximate
quantiles of the whole table, a bounded list of numbers; a range is ordered by
itself, and only the ranges' totals are summed in order.  Where the cuts lie changes
who does the work, never the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RANGES = 64


def split_points(df: DataFrame, value: str, ranges: int = RANGES) -> list[float]:
    """Up to ``ranges - 1`` increasing values that cut the table into about equal parts."""
    levels = [i / ranges for i in range(1, ranges)]
    if not levels:
        return []
    found = df.select(F.col(value).cast("double").alias("v")).where("v IS NOT NULL").approxQuantile("v", levels, 0.5 / ranges)
    return sorted(set(found or []))


def _range_of(value: Column, splits: list[float]) -> Column:
    """The number of cuts below the value."""
    if not splits:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(float(s)) for s in splits]), lambda s: s < value.cast("double")))


def cumulative(df: DataFrame, by: list[str], value: str, splits: list[float]) -> DataFrame:
    """(by, value, n, before, total): rows with a value, with smaller ones, and of the group."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n")).withColumn("_r", _range_of(F.col(value), splits))
    keys = [*by, "_r"]
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("_t"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    # One row per group and range.
    earlier = group.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_start"), F.sum("_t").over(group).alias("total"))
    within = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    own = counts.withColumn("_within", F.coalesce(F.sum("n").over(within), F.lit(0)))
    match = F.lit(True)
    for i, c in enumerate(keys):
        match = match & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    met = own.join(starts, match)
    return met.select(*by, value, "n", (F.col("_start") + F.col("_within")).alias("before"), "total")


def quantiles(df: DataFrame, by: list[str], value: str, levels: dict[str, float], ranges: int = RANGES) -> DataFrame:
    """Exact quantiles with linear interpolation, a column per name in ``levels``, and n, the known values."""
    counted = cumulative(df, by, value, split_points(df, value, ranges))
    place = {name: p * (F.col("total") - 1) for name, p in levels.items()}
    upto = F.col("before") + F.col("n")
    low = [F.min(F.when(upto > F.floor(c), F.col(value))).cast("double").alias(f"_l_{name}") for name, c in place.items()]
    high = [F.min(F.when(upto > F.ceil(c), F.col(value))).cast("double").alias(f"_h_{name}") for name, c in place.items()]
    ends = counted.groupBy(*by, "total").agg(*low, *high)
    between = {name: F.col(f"_l_{name}") + (c - F.floor(c)) * (F.col(f"_h_{name}") - F.col(f"_l_{name}")) for name, c in place.items()}
    return ends.select(*by, F.col("total").alias("n"), *[c.alias(name) for name, c in between.items()])
