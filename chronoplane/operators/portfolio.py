"""Backtests, performance and changes of weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PERIODS = 52


def backtest(weights: DataFrame, key: str, order: str, weight: str, a: str, b: str, cost_bps: float = 5.0) -> DataFrame:
    """Net returns and value of holding ``weight`` of price a and the rest of price b.

    The first row has no turnover and the last has no return and is left out.
    """
    w = Window.partitionBy(key).orderBy(order)
    gain = F.col(weight) * (F.lead(a).over(w) / F.col(a) - 1) + (1 - F.col(weight)) * (F.lead(b).over(w) / F.col(b) - 1)
    turnover = F.coalesce(F.abs(F.col(weight) - F.lag(weight).over(w)), F.lit(0.0))
    rows = weights.withColumn("gross", gain).withColumn("turnover", turnover).withColumn("cost", turnover * cost_bps / 10_000).where("gross IS NOT NULL")
    rows = rows.withColumn("ret", F.col("gross") - F.col("cost"))
    return rows.withColumn("nav", F.exp(F.sum(F.log(1 + F.col("ret"))).over(w.rowsBetween(Window.unboundedPreceding, 0))))


def drawdown(key: str, order: str, nav: Column) -> Column:
    """Fall from the highest value so far, the first value being the first peak."""
    return 1 - nav / F.max(nav).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def performance(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Eleven measures of a series of periodic returns with turnover and cost."""
    w = Window.partitionBy(key).orderBy(order)
    four = w.rowsBetween(-3, 0)
    ready = rows.withColumn("dd", drawdown(key, order, F.col("nav"))).withColumn("r4", F.when(F.count("ret").over(four) == 4, F.exp(F.sum(F.log(1 + F.col("ret"))).over(four)) - 1))
    n = F.count("ret")
    growth = F.exp(F.sum(F.log(1 + F.col("ret"))) * PERIODS / n) - 1
    vol = F.stddev_samp("ret") * F.sqrt(F.lit(float(PERIODS)))
    loss = F.least("ret", F.lit(0.0))
    mean = F.avg("ret") * PERIODS
    return ready.groupBy(key).agg(
        growth.alias("annual_return"), vol.alias("annual_vol"), (mean / vol).alias("sharpe"), (mean / (F.sqrt(F.sum(loss * loss) / n) * F.sqrt(F.lit(float(PERIODS))))).alias("sortino"),
        F.max("dd").alias("max_drawdown"), (growth / F.max("dd")).alias("calmar"), (F.avg("turnover") * PERIODS).alias("turnover"), (F.avg("cost") * PERIODS).alias("cost_drag"),
        (F.count_if(F.col("ret") > 0) / n).alias("hit_ratio"), F.min("ret").alias("worst_week"), F.min("r4").alias("worst_four"),
    )


def portfolio_delta(current: DataFrame, target: DataFrame, keys: list[str], symbol: str, floor: float) -> DataFrame:
    """Weight changes by symbol with the account's turnover; small ones aren't traded."""
    both = current.join(target, [*keys, symbol], "full_outer").na.fill(0.0, ["weight", "target"])
    change = F.col("target") - F.col("weight")
    turnover = F.sum(F.abs(change)).over(Window.partitionBy(*keys)) / 2
    return both.withColumn("delta", change).withColumn("turnover", turnover).withColumn("trades", F.col("turnover") >= floor - 1e-12)
