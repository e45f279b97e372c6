"""Which store a week is read from, decided before anything is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where a week may be read from.
STRICT, BACKFILL, BLOCKED, LEGACY, NOWHERE = "stores_strict", "stores_backfill", "controlled_block", "legacy_cache_micro", "none"
#: Stores whose rows a week takes; the others freeze or block it.
READ = (STRICT, LEGACY)


def route(mode: Column, gate_passed: Column, gate_reason: Column, has_legacy: Column) -> dict[str, Column]:
    """store, scheme, strict_ok and reason of a week from its backfill result, null for a week that isn't controlled.

    The strict store is used if its gate passed; a degraded week freezes what it
    has; any other result blocks the week.  Other weeks use the legacy store.
    """
    strict, degraded = mode == "strict_recovery", mode == "degraded_backfill"
    passed = F.coalesce(gate_passed, F.lit(False))
    cases = [
        (mode.isNull() & has_legacy, LEGACY, None, F.lit("legacy_cache_micro_used_for_non_controlled_week")),
        (mode.isNull(), NOWHERE, None, F.lit("legacy_cache_micro_missing")),
        (strict & passed, STRICT, "strict_recovery", F.lit("strict_store_gate_passed")),
        (strict, BLOCKED, "block", F.concat(F.lit("strict_store_gate_failed:"), F.coalesce(gate_reason, F.lit("unknown")))),
        (degraded, BACKFILL, "degraded_backfill", F.lit("controlled_degraded_backfill_freezes_micro")),
        (F.lit(True), BLOCKED, "block", F.lit("controlled_block_prevents_strict_contracts")),
    ]
    pick = lambda at: F.coalesce(*[F.when(case[0], case[at] if isinstance(case[at], Column) else F.lit(case[at])) for case in cases if case[at] is not None])
    scheme = F.when(mode.isNull(), F.lit(None).cast("string")).otherwise(pick(2))
    return {"store": pick(1), "scheme": scheme, "strict_ok": F.coalesce(strict & passed, F.lit(False)), "reason": pick(3)}


def routed(weeks: DataFrame, mode: str, gate_passed: str, gate_reason: str, has_legacy: str) -> DataFrame:
    """Add store, scheme, strict_ok and reason to the weeks."""
    return weeks.withColumns(route(F.col(mode), F.col(gate_passed), F.col(gate_reason), F.coalesce(F.col(has_legacy), F.lit(False))))


def read_routed(spark: SparkSession, path: str, routes: DataFrame, week: str = "week_end") -> DataFrame:
    """The rows of the stores under ``path`` that the routes name, with scheme and reason.

    Stores are one table partitioned by store and week.  The join with the short
    table of routes prunes partitions while the query runs: only the chosen store of
    each week is opened.
    """
    chosen = routes.where(F.col("store").isin(*READ)).select("store", F.col(week).alias("_week"), "scheme", "reason")
    facts = spark.read.parquet(path)
    met = facts.join(chosen.withColumnRenamed("store", "_store"), (F.col("store") == F.col("_store")) & (F.col(week) == F.col("_week")))
    return met.drop("_store", "_week")


def modes(weeks: DataFrame, week: str = "week_end") -> DataFrame:
    """How a week's decision is marked: strict, degraded or blocked by its route."""
    mode = F.when(F.col("strict_ok"), "strict").when(F.col("store").isin(BLOCKED, NOWHERE), "blocked").otherwise("degraded")
    return weeks.select(week, mode.alias("mode"), "reason")
