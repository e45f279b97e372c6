"""Portfolio policy: bucket sets, target weights behind a gate, and simulated orders on paper."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EPSILON = 1e-9


def check_buckets(buckets: DataFrame, policy: str) -> DataFrame:
    """Per policy the first fault of its buckets of [0, 1], or ``ok``.

    Buckets (lower, upper, lower_inclusive, upper_inclusive) must start at 0 and
    end at 1, both included, without gaps or overlaps, and each shared bound must
    belong to exactly one side.
    """
    by = Window.partitionBy(policy).orderBy("lower", "upper")
    step = buckets.withColumns({
        "_up": F.lag("upper").over(by), "_in": F.lag("upper_inclusive").over(by), "_first": F.row_number().over(by) == 1, "_last": F.lead("lower").over(by).isNull(),
    })
    rules = [
        (F.col("_first") & ((F.col("lower") != 0) | ~F.col("lower_inclusive")), 0, "start"),
        (F.col("_last") & ((F.col("upper") != 1) | ~F.col("upper_inclusive")), 1, "end"),
        (F.col("_up") < F.col("lower") - EPSILON, 2, "gap"),
        (F.col("_up") > F.col("lower") + EPSILON, 2, "overlap"),
        (F.col("_in") & F.col("lower_inclusive"), 2, "bound_in_both"),
        (~F.col("_in") & ~F.col("lower_inclusive"), 2, "bound_in_neither"),
    ]
    # Ends are checked before neighbours, these in order of the bounds.
    fault = F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(stage).alias("stage"), F.col("lower").alias("at"), F.lit(i).alias("i"), F.lit(name).alias("name"))) for i, (c, stage, name) in enumerate(rules)])
    return step.groupBy(policy).agg(F.coalesce(F.min(fault)["name"], F.lit("ok")).alias("verdict"), F.count(F.lit(1)).alias("n_buckets"))


def locate(df: DataFrame, buckets: DataFrame, policy: str, value: str) -> DataFrame:
    """Add bucket: the first, by place, of the policy's buckets that holds the value; null where none does.

    A policy has a handful of buckets; they are gathered per policy and searched in each row.
    """
    row = F.struct("place", "name", "lower", "upper", "lower_inclusive", "upper_inclusive")
    sets = buckets.groupBy(policy).agg(F.array_sort(F.collect_list(row)).alias("_b"))
    x = F.col(value)
    holds = lambda b: ((x > b["lower"]) | (b["lower_inclusive"] & (x == b["lower"]))) & ((x < b["upper"]) | (b["upper_inclusive"] & (x == b["upper"])))
    return df.join(sets, policy, "left").withColumn("bucket", F.get(F.filter("_b", holds), F.lit(0))["name"]).drop("_b")


def target_weights(df: DataFrame, weights: dict[str, dict[str, float]], symbols: list[str], cash: str, prior: str) -> DataFrame:
    """Add target (a map by symbol), generation_mode, target_reason, gross and net exposure.

    An eligible signal takes its bucket's weights; otherwise the prior target is
    held, or all is cash where there is none.  An eligible signal without a bucket
    is an error.
    """
    entry = lambda w: F.create_map(*[x for s in symbols for x in (F.lit(s), F.lit(float(w.get(s, 0.0))))])
    policy = F.lit(None).cast("map<string,double>")
    for name, own in weights.items():
        if abs(sum(own.values()) - 1) > EPSILON or set(own) - set(symbols):
            raise ValueError(f"weights of bucket {name} must sum to 1 over the policy's symbols")
        policy = F.when(F.col("bucket") == name, entry(own)).otherwise(policy)
    eligible = F.coalesce("signal_eligible", F.lit(False))
    strict = F.coalesce(policy, F.raise_error(F.lit("no bucket holds the score of an eligible signal")).cast("map<string,double>"))
    target = F.when(eligible, strict).otherwise(F.coalesce(F.col(prior), entry({cash: 1.0})))
    reason = F.when(eligible, "eligible_strict_signal").when(F.col(prior).isNotNull(), F.col("reason")).otherwise("no_prior_target_defensive_cash_proxy")
    out = df.withColumn("target", target).withColumn("generation_mode", F.when(eligible, "policy_bucket_mapping").otherwise("hold_prior_or_policy_default")).withColumn("target_reason", reason)
    total = lambda f: F.aggregate(F.map_values("target"), F.lit(0.0), lambda acc, x: acc + f(x))
    return out.withColumn("gross_exposure", total(F.abs)).withColumn("net_exposure", total(lambda x: x))


class OrderSimulation:
    """Orders of one account in sequence: sells by symbol, then buys by symbol; sells fund buys.

    An order below the least notional is left out.  A buy is cut to what cash,
    commission, slippage and a friction buffer allow, but is charged slippage and
    commission only; cash never goes below zero.  Nothing leaves the engine:
    orders are rows.
    """

    SCHEMA = "side string, notional double, quantity double, slippage_cost double, commission double, total_cost double, sequence int, cash double"

    def __init__(self, cash: float = 0.0, slippage_bps: float = 5.0, buffer_bps: float = 10.0, commission: float = 0.0, least: float = 50.0):
        self.cash, self.slippage, self.friction = cash, slippage_bps / 10_000, (slippage_bps + buffer_bps) / 10_000
        self.commission, self.least, self.sequence = commission, least, 0

    def step(self, desired, price):
        none = (None, None, None, None, None, None, None, self.cash)
        if desired is None or desired == 0:
            return none
        size = abs(desired) if desired < 0 else min(desired, max(0.0, (self.cash - self.commission) / (1 + self.friction)))
        if size < self.least:
            return none
        cost = size * self.slippage + self.commission
        self.cash = self.cash + size - cost if desired < 0 else max(0.0, self.cash - size - cost)
        self.sequence += 1
        return "SELL" if desired < 0 else "BUY", size, size / price, size * self.slippage, self.commission, cost, self.sequence, self.cash


def order_summary(orders: DataFrame, keys: list[str], allowed: Column) -> DataFrame:
    """Per account its number of orders, costs, cash and why there are orders or none."""
    filled = F.col("side").isNotNull()
    total = lambda c: F.coalesce(F.sum(F.when(filled, F.col(c))), F.lit(0.0))
    out = orders.groupBy(*keys).agg(
        F.count_if(filled).alias("orders_count"), total("slippage_cost").alias("estimated_slippage_cost"), total("commission").alias("estimated_commission"), total("total_cost").alias("estimated_total_cost"),
        F.max_by("cash", "place").alias("cash_after_orders"), F.bool_and(allowed).alias("_ok"),
    )
    return out.withColumn("reason", F.when(~F.col("_ok"), "rebalance_not_required").when(F.col("orders_count") > 0, "orders_generated").otherwise("no_orders_generated")).drop("_ok")
