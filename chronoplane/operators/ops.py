"""Freshness, execution state and decisions of a weekly run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def freshness(observed: DataFrame, source: str, ts: str, required: Column, blocking: list[str]) -> DataFrame:
    """Per source its last observation, whether it reaches the required day, and the level if not."""
    out = observed.groupBy(source).agg(F.max(ts).alias("last_seen"))
    fresh = F.coalesce(F.col("last_seen") >= required, F.lit(False))
    level = F.when(fresh, "ok").when(F.col(source).isin(blocking), "block").otherwise("degrade")
    return out.withColumn("fresh", fresh).withColumn("level", level)


def execution_state(fresh: DataFrame, by: list[str], source: str) -> DataFrame:
    """Block outranks degrade, degrade outranks execute; reasons in order of source."""
    reasons = F.array_join(F.array_sort(F.collect_list(F.when(F.col("level") != "ok", F.concat(F.col(source), F.lit(":"), F.col("level"))))), ";")
    state = F.when(F.bool_or(F.col("level") == "block"), "block").when(F.bool_or(F.col("level") == "degrade"), "degrade").otherwise("execute")
    return fresh.groupBy(*by).agg(state.alias("state"), reasons.alias("reasons"))


def backfill_decision(proof: Column, verdict: Column) -> Column:
    """Scheme from a publication proof and the validation of the holdings."""
    return F.when(proof & (verdict == "passed_strict"), "strict").when(verdict.isin("passed_strict", "passed_degraded_only"), "degraded").otherwise("block")


def order_lines(df: DataFrame, keys: list[str], amount: str) -> DataFrame:
    """Orders as text with fixed decimals, the form in which they are written."""
    return df.select(F.concat_ws(",", *[F.col(k).cast("string") for k in keys], F.printf(F.lit("%.10f"), F.col(amount))).alias("line"))
