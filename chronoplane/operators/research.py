"""Realised and forward measures around decision days, separation of states, and predictive rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoplane.operators.risk import normal_tail
from chronoplane.operators.stats import ols_hac, spearman, value_ranks

PERIODS = 52.0


def chi2_tail(x: Column, df: Column, most: int = 6) -> Column:
    """Upper tail of the chi-square distribution, for 1 to ``most`` degrees of freedom."""
    out = F.lit(None).cast("double")
    for k in range(1, most + 1):
        if k % 2:
            term, total = F.sqrt(x), F.lit(0.0)
            for i in range(1, (k - 1) // 2 + 1):
                total = total + term
                term = term * x / (2 * i + 1)
            tail = normal_tail(F.sqrt(x)) + 2 * F.exp(-x / 2) / F.sqrt(F.lit(2.0) * F.pi()) * total
        else:
            term, total = F.lit(1.0), F.lit(1.0)
            for i in range(1, k // 2):
                term = term * x / (2 * i)
                total = total + term
            tail = F.exp(-x / 2) * total
        out = F.when(df == k, tail).otherwise(out)
    return out


def _spread(returns: Column, least: int) -> Column:
    """Annualised sample deviation of an array of returns, null for fewer than ``least`` or two."""
    n = F.size(returns)
    add = lambda acc, x: acc + x
    mean = F.aggregate(returns, F.lit(0.0), add) / n
    squares = F.aggregate(F.transform(returns, lambda r: (r - mean) * (r - mean)), F.lit(0.0), add)
    return F.when(n >= max(2, least), F.sqrt(squares / (n - 1)) * F.sqrt(F.lit(PERIODS)))


def _fall(prices: Column, start: Column) -> Column:
    """The largest fall from a running peak, as a share of the peak."""
    zero = F.struct(start.alias("peak"), F.lit(0.0).alias("fall"))
    step = lambda acc, p: F.struct(F.greatest(acc["peak"], p).alias("peak"), F.greatest(acc["fall"], 1 - p / F.greatest(acc["peak"], p)).alias("fall"))
    return F.aggregate(prices, zero, step, lambda acc: acc["fall"])


def _timeline(prices: DataFrame, asked: DataFrame, key: str, day: str, price: str) -> tuple[DataFrame, str]:
    """Prices and asked days on one axis: _d, _p and _r (log return, of price rows only), _asked."""
    by = Window.partitionBy(key).orderBy(day)
    own = prices.where(F.col(price).isNotNull()).select(key, day, F.col(price).cast("double").alias("_p")).withColumn("_r", F.log(F.col("_p") / F.lag("_p").over(by)))
    rows = own.join(asked.select(key, day).distinct().withColumn("_asked", F.lit(True)), [key, day], "full_outer")
    return rows.withColumn("_d", F.datediff(day, F.lit("1970-01-01").cast("date"))), "_d"


def realized_set(prices: DataFrame, asked: DataFrame, key: str, day: str, price: str) -> DataFrame:
    """r1w, R4w, sigma4w and mdd8w at each asked day, from prices up to it only.

    Returns run from the last price 5 or 25 days back; the deviation is of the
    returns within the last 28 days, the fall within the last 56.  Fewer than two
    prices of history give nulls.
    """
    rows, d = _timeline(prices, asked, key, day, price)
    w = Window.partitionBy(key).orderBy(d)
    back = lambda n: F.last("_p", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, -n))
    span = lambda c, n: F.collect_list(c).over(w.rangeBetween(-(n - 1), 0))
    held = rows.withColumns({"_now": back(0), "_p1": back(5), "_p4": back(25), "_w4": span(F.when(F.col("_p").isNotNull(), F.struct("_r")), 28), "_w8": span("_p", 56), "_n": F.count("_p").over(w.rangeBetween(Window.unboundedPreceding, 0))})
    # The window's first return comes from before it.
    inside = F.when(F.size("_w4") > 1, F.transform(F.slice("_w4", 2, F.size("_w4")), lambda x: x["_r"]))
    known = F.col("_n") >= 2
    return held.where("_asked").select(
        key, day, F.when(known, F.log(F.col("_now") / F.col("_p1"))).alias("r1w"), F.when(known, F.log(F.col("_now") / F.col("_p4"))).alias("R4w"),
        F.when(known, _spread(inside, 2)).alias("sigma4w"), F.when(known & (F.size("_w8") >= 2), _fall(F.col("_w8"), F.get("_w8", F.lit(0)))).alias("mdd8w"),
    )


def forward_set(prices: DataFrame, asked: DataFrame, key: str, day: str, price: str, horizons: list[int]) -> DataFrame:
    """fwd_ret, fwd_vol and fwd_mdd over the weeks after each asked day, per horizon in weeks."""
    rows, d = _timeline(prices, asked, key, day, price)
    w = Window.partitionBy(key).orderBy(d)
    out = rows.withColumn("_now", F.last("_p", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0)))
    out = out.withColumns({f"_w{h}": F.collect_list(F.when(F.col("_p").isNotNull(), F.struct("_p", "_r"))).over(w.rangeBetween(1, 7 * h)) for h in horizons})
    made = []
    for h in horizons:
        held, n = F.col(f"_w{h}"), F.size(f"_w{h}")
        there = F.col("_now").isNotNull() & (n > 0)
        inside = F.when(n > 1, F.transform(F.slice(held, 2, n), lambda x: x["_r"]))
        made += [
            F.when(there, F.log(F.element_at(held, -1)["_p"] / F.col("_now"))).alias(f"fwd_ret_{h}w"),
            F.when(there, _spread(inside, 2)).alias(f"fwd_vol_{h}w"),
            F.when(there, _fall(F.transform(held, lambda x: x["_p"]), F.col("_now"))).alias(f"fwd_mdd_{h}w"),
        ]
    return out.where("_asked").select(key, day, *made)


def state_descriptives(long: DataFrame) -> DataFrame:
    """Per metric and state: n_obs, median and quartiles of the known values."""
    known = long.where(F.col("value").isNotNull())
    return known.groupBy("metric", "state").agg(F.count(F.lit(1)).alias("n_obs"), F.median("value").alias("median"), F.percentile("value", 0.25).alias("q25"), F.percentile("value", 0.75).alias("q75"))


def separation(long: DataFrame) -> DataFrame:
    """Per metric the rank test over its states with three values or more; null for fewer than two states."""
    sizes = Window.partitionBy("metric", "state")
    known = long.where(F.col("value").isNotNull()).withColumn("_n", F.count(F.lit(1)).over(sizes)).where("_n >= 3")
    ranks = value_ranks(known, ["metric"], "value")
    whole = ranks.groupBy("metric").agg(F.sum("n").alias("total"), F.sum((F.col("n") * F.col("n") * F.col("n") - F.col("n")).cast("double")).alias("ties"))
    sums = known.join(ranks.select("metric", "value", "rank"), ["metric", "value"]).groupBy("metric", "state").agg(F.count(F.lit(1)).alias("n"), F.sum("rank").alias("rank_sum"))
    n = F.col("total").cast("double")
    out = sums.join(whole, "metric").groupBy("metric", "total", "ties").agg(F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("_s"), F.count(F.lit(1)).alias("n_states"))
    out = out.withColumn("kw_stat", F.when(F.col("n_states") > 1, (12 / (n * (n + 1)) * F.col("_s") - 3 * (n + 1)) / (1 - F.col("ties") / (n * n * n - n))))
    return out.select("metric", "total", "n_states", "kw_stat", chi2_tail(F.col("kw_stat"), F.col("n_states") - 1).alias("kw_pvalue"))


def pairwise(long: DataFrame, n_states: int = 5) -> DataFrame:
    """All pairs of states per metric: z of the mean ranks, its tail, the step-down correction, and the excess of larger values.

    A pair with a state of fewer than two values has p 1.  The excess comes from
    rank sums within the pair, not from pairs of values.
    """
    known = long.where(F.col("value").isNotNull())
    ranks = value_ranks(known, ["metric"], "value")
    whole = ranks.groupBy("metric").agg(F.sum("n").cast("double").alias("total"), F.sum((F.col("n") * F.col("n") * F.col("n") - F.col("n")).cast("double")).alias("ties"))
    means = known.join(ranks.select("metric", "value", "rank"), ["metric", "value"]).groupBy("metric", "state").agg(F.count(F.lit(1)).alias("n"), F.avg("rank").alias("mean"))
    every = F.explode(F.array(*[F.struct(F.lit(i).alias("state_i"), F.lit(j).alias("state_j")) for i in range(n_states) for j in range(i + 1, n_states)])).alias("s")
    pairs = whole.select("metric", "total", "ties", every).select("metric", "total", "ties", "s.*")
    side = lambda x: means.select("metric", F.col("state").alias(f"state_{x}"), F.col("n").alias(f"n_{x}"), F.col("mean").alias(f"mean_{x}"))
    pairs = pairs.join(side("i"), ["metric", "state_i"], "left").join(side("j"), ["metric", "state_j"], "left")
    n = F.col("total")
    se = F.sqrt((n * (n + 1) / 12 - F.col("ties") / (12 * (n - 1))) * (1 / F.col("n_i") + 1 / F.col("n_j")))
    enough = (F.coalesce("n_i", F.lit(0)) >= 2) & (F.coalesce("n_j", F.lit(0)) >= 2)
    pairs = pairs.withColumn("z_stat", F.when(enough, F.when(se > 0, (F.col("mean_i") - F.col("mean_j")) / se).otherwise(0.0))).withColumn("pvalue_raw", F.when(enough, normal_tail(F.col("z_stat"))).otherwise(1.0))
    order = Window.partitionBy("metric").orderBy("pvalue_raw", "state_i", "state_j")
    scaled = F.least(F.lit(1.0), F.col("pvalue_raw") * (F.count(F.lit(1)).over(Window.partitionBy("metric")) - F.row_number().over(order) + 1))
    pairs = pairs.withColumn("_h", scaled).withColumn("pvalue_holm", F.max("_h").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("significant", F.col("pvalue_holm") < 0.05)
    # A value meets each pair that its state is in: a few copies, then ranks within the pair.
    ends = pairs.select(F.concat_ws("|", "metric", "state_i", "state_j").alias("cell"), "metric", "state_i", "state_j", F.explode(F.array("state_i", "state_j")).alias("state"))
    members = known.join(ends, ["metric", "state"])
    within = members.join(value_ranks(members, ["cell"], "value").select("cell", "value", "rank"), ["cell", "value"])
    first = F.col("state") == F.col("state_i")
    deltas = within.groupBy("metric", "state_i", "state_j").agg(F.count_if(first).alias("a"), F.count_if(~first).alias("b"), F.sum(F.when(first, F.col("rank"))).alias("r"))
    delta = F.when((F.col("a") > 0) & (F.col("b") > 0), 2 * (F.col("r") - F.col("a") * (F.col("a") + 1) / 2) / (F.col("a") * F.col("b")) - 1).alias("cliffs_delta")
    out = pairs.join(deltas.select("metric", "state_i", "state_j", delta), ["metric", "state_i", "state_j"], "left")
    return out.select("metric", "state_i", "state_j", "z_stat", "pvalue_raw", "pvalue_holm", "significant", "cliffs_delta")


def separation_passes(tests: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: whether deviation and fall both separate the states, and the low from the high ones."""
    low_high = F.col("state_i").isin(0, 1) & F.col("state_j").isin(3, 4)
    found = pairs.groupBy("metric").agg(F.bool_or("significant").alias("any"), F.bool_or(F.col("significant") & low_high).alias("far"))
    both = tests.where(F.col("metric").isin("sigma4w", "mdd8w")).join(found, "metric")
    ok = lambda m: F.coalesce(F.bool_or((F.col("metric") == m) & (F.col("kw_pvalue") < 0.05) & F.col("any")), F.lit(False))
    return both.agg(ok("sigma4w").alias("sigma_ok"), ok("mdd8w").alias("mdd_ok"), F.coalesce(F.bool_or("far"), F.lit(False)).alias("low_high_ok")).withColumn("passed", F.col("sigma_ok") & F.col("mdd_ok") & F.col("low_high_ok"))


def predictive_rows(df: DataFrame, order: str, signals: list[str], horizons: list[int], bases: list[str], high_confidence: Column, by: str | None = None) -> DataFrame:
    """A row per signal, horizon, target and subsample (and key ``by``): rank correlation, robust slope, terciles.

    Targets are columns ``<base>_<horizon>w``.  Fewer than ten pairs give nulls.
    """
    targets = [(h, f"{b}_{h}w") for h in horizons for b in bases]
    grid = F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("x"), F.lit(h).alias("horizon_weeks"), F.lit(t).alias("target"), F.col(t).alias("y")) for s in signals for h, t in targets])).alias("g")
    keys = [by] if by else []
    rows = df.select(*keys, order, F.coalesce(high_confidence, F.lit(False)).alias("_hc"), grid).select(*keys, order, "_hc", "g.*").where("x IS NOT NULL AND y IS NOT NULL")
    rows = rows.withColumn("subsample", F.explode(F.when(F.col("_hc"), F.array(F.lit("full"), F.lit("high_conf"))).otherwise(F.array(F.lit("full")))))
    cell = [*keys, "signal", "horizon_weeks", "target", "subsample"]
    rows = rows.withColumn("cell", F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cell]))
    sizes = rows.groupBy("cell", *cell).agg(F.count(F.lit(1)).alias("n_obs"), F.percentile("x", 0.333).alias("_lo"), F.percentile("x", 0.667).alias("_hi"))
    enough = rows.join(sizes.where("n_obs >= 10").select("cell"), "cell", "left_semi")
    slopes = None
    for h in horizons:
        part = ols_hac(enough.where(F.col("horizon_weeks") == h), "cell", order, "y", "x", max(h - 1, 4)).select("cell", F.col("slope").alias("ols_beta"), F.col("t").alias("hac_tstat"), F.col("p").alias("hac_pvalue"))
        slopes = part if slopes is None else slopes.unionByName(part)
    cuts = enough.join(sizes.select("cell", "_lo", "_hi"), "cell").groupBy("cell").agg(F.median(F.when(F.col("x") <= F.col("_lo"), F.col("y"))).alias("tercile_bottom_median"), F.median(F.when(F.col("x") >= F.col("_hi"), F.col("y"))).alias("tercile_top_median"))
    out = sizes.drop("_lo", "_hi").join(spearman(enough, "cell", "x", "y").select("cell", F.col("spearman").alias("spearman_rho")), "cell", "left").join(slopes, "cell", "left").join(cuts, "cell", "left")
    return out.drop("cell").withColumn("tercile_spread", F.col("tercile_top_median") - F.col("tercile_bottom_median"))


def predictive_passes(rows: DataFrame, signals: list[str], by: str | None = None) -> DataFrame:
    """One row (per key ``by``): whether a signal predicts deviation or fall 4 or 8 weeks ahead, upwards, in both subsamples."""
    keys = [by] if by else []
    full = rows.where(F.col("subsample") == "full")
    other = rows.where(F.col("subsample") == "high_conf").select(*keys, "signal", "horizon_weeks", "target", F.col("ols_beta").alias("_other"))
    asked = full.where(F.col("signal").isin(*signals) & F.col("horizon_weeks").isin(4, 8) & F.col("target").rlike("^fwd_(vol|mdd)_"))
    good = (F.col("ols_beta") > 0) & (F.col("hac_pvalue") < 0.10) & (F.col("tercile_spread") > 0) & ~F.coalesce(F.col("_other") * F.col("ols_beta") < 0, F.lit(False))
    return asked.join(other, [*keys, "signal", "horizon_weeks", "target"]).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_candidates"), F.count_if(good).alias("n_passing"), F.coalesce(F.bool_or(good), F.lit(False)).alias("passed"))
