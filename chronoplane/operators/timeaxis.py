"""Weeks that end on Friday, business days, and resampling onto them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def week_end(day: Column) -> Column:
    """The Friday on or after a day."""
    return F.date_add(day, F.pmod(F.lit(6) - F.dayofweek(day), F.lit(7)))


def is_business_day(day: Column) -> Column:
    return F.dayofweek(day).between(2, 6)


def sla_cutoff(friday: Column, clock: str = "12:00:00", zone: str = "America/New_York") -> Column:
    """The UTC instant by which a week's result is due: the Saturday after, local time."""
    return F.to_utc_timestamp(F.concat_ws(" ", F.date_add(friday, 1).cast("string"), F.lit(clock)).cast("timestamp_ntz"), zone)


def decision_index(df: DataFrame, key: str, ts: str) -> DataFrame:
    """The last observed timestamp of each week."""
    return df.groupBy(key, week_end(F.to_date(ts)).alias("week_end")).agg(F.max(ts).alias("decision_ts"))


def every_week(df: DataFrame, key: str, day: str) -> DataFrame:
    """(key, week_end) of all weeks between a key's first and last day."""
    span = df.groupBy(key).agg(week_end(F.min(day)).alias("lo"), week_end(F.max(day)).alias("hi"))
    return span.select(key, F.explode(F.sequence("lo", "hi", F.expr("interval 7 days"))).alias("week_end"))


def weekly_last(df: DataFrame, key: str, day: str, values: list[str]) -> DataFrame:
    """Last known value per week, carried forward over weeks without one.

    Empty weeks appear, missing values are skipped, and nothing is filled backwards.
    """
    weekly = df.groupBy(key, week_end(F.col(day)).alias("week_end")).agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), F.col(day))).alias(v) for v in values])
    upto = Window.partitionBy(key).orderBy("week_end").rowsBetween(Window.unboundedPreceding, 0)
    full = every_week(df, key, day).join(weekly, [key, "week_end"], "left")
    return full.select(key, "week_end", *[F.last(v, ignorenulls=True).over(upto).alias(v) for v in values])


def weekly_median(df: DataFrame, key: str, day: str, values: list[str]) -> DataFrame:
    """Median per week; a week without values has nulls."""
    weekly = df.groupBy(key, week_end(F.col(day)).alias("week_end")).agg(*[F.median(v).alias(v) for v in values])
    return every_week(df, key, day).join(weekly, [key, "week_end"], "left")


def checked_index(df: DataFrame, key: str, ts: str) -> DataFrame:
    """Per key: whether the timestamps are never null, never repeated."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(ts).isNull()).alias("n_null"), (F.count(ts) - F.count_distinct(ts)).alias("n_repeated"))
