"""Rank tests, correlations and regressions as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoplane.operators.ranking import cumulative, split_points
from chronoplane.operators.risk import chi2_tail_even, normal_tail


def value_ranks(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, n, rank): ties share their mean rank.

    Values are counted first, so the ordered pass sees each value once.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("rank", F.sum("n").over(upto) - (F.col("n") - 1) / 2)


def rank_sums(df: DataFrame, group: str, value: str) -> DataFrame:
    """Per group its size and rank sum, with the whole sample's size and tie term.

    The whole sample is ranked in ranges of values, so no task orders it.
    """
    counted = cumulative(df, [], value, split_points(df, value))
    ranks = counted.select(value, "n", (F.col("before") + (F.col("n") + 1) / 2).alias("rank"))
    # Cubes of counts pass 64 bits from 2,097,152 on.
    n = F.col("n").cast("double")
    whole = ranks.agg(F.sum("n").alias("total"), F.sum(n * n * n - n).alias("ties"))
    held = df.join(ranks.select(value, "rank"), value).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum("rank").alias("rank_sum"))
    return held.crossJoin(F.broadcast(whole))


def kruskal(sums: DataFrame, n_groups: int) -> DataFrame:
    n = F.col("total").cast("double")
    raw = 12 / (n * (n + 1)) * F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")) - 3 * (n + 1)
    out = sums.groupBy("total", "ties").agg(raw.alias("raw")).withColumn("h", F.col("raw") / (1 - F.col("ties") / (n * n * n - n)))
    return out.select("total", "h", chi2_tail_even(F.col("h"), n_groups - 1).alias("p_value"))


def dunn_holm(sums: DataFrame, group: str) -> DataFrame:
    """Pairs of groups: z, two-sided p and its step-down correction, never decreasing."""
    other = sums.select(F.col(group).alias("b"), F.col("n").alias("nb"), F.col("rank_sum").alias("rb"))
    n = F.col("total").cast("double")
    spread = (n * (n + 1) / 12 - F.col("ties") / (12 * (n - 1))) * (1 / F.col("n") + 1 / F.col("nb"))
    pairs = sums.withColumnRenamed(group, "a").join(F.broadcast(other), F.col("a") < F.col("b"))
    pairs = pairs.withColumn("z", (F.col("rank_sum") / F.col("n") - F.col("rb") / F.col("nb")) / F.sqrt(spread)).withColumn("p", normal_tail(F.col("z")))
    order = Window.partitionBy("total").orderBy("p", "a", "b")
    scaled = F.least(F.lit(1.0), F.col("p") * (F.count(F.lit(1)).over(Window.partitionBy("total")) - F.row_number().over(order) + 1))
    pairs = pairs.withColumn("_s", scaled)
    return pairs.select("a", "b", "z", "p", F.max("_s").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("p_holm"))


def cliffs_delta(df: DataFrame, group: str, value: str, a: str, b: str) -> DataFrame:
    """Excess of pairs with a above b, from rank sums instead of pairs."""
    s = rank_sums(df.where(F.col(group).isin(a, b)), group, value)
    top = F.max(F.when(F.col(group) == a, F.col("rank_sum") - F.col("n") * (F.col("n") + 1) / 2))
    na, nb = F.max(F.when(F.col(group) == a, F.col("n"))), F.max(F.when(F.col(group) == b, F.col("n")))
    return s.agg((2 * top / (na * nb) - 1).alias("delta"))


def spearman(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = both.join(value_ranks(both, [by], x).select(by, x, F.col("rank").alias("_rx")), [by, x]).join(value_ranks(both, [by], y).select(by, y, F.col("rank").alias("_ry")), [by, y])
    return ranked.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.corr("_rx", "_ry").alias("spearman"))


def ols_hac(df: DataFrame, by: str, order: str, y: str, x: str, lag: int) -> DataFrame:
    """Slope of y on x with a standard error that allows for serial correlation.

    With an intercept the slope's part of the sandwich is a sum over the products
    of the centred regressor and the residual, weighted by a triangular kernel.
    """
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    line = known.groupBy(by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.avg(x).alias("_mx"), F.count(F.lit(1)).alias("n"))
    g = known.join(line, by).withColumn("_c", F.col(x) - F.col("_mx")).withColumn("_g", F.col("_c") * (F.col(y) - F.col("intercept") - F.col("slope") * F.col(x)))
    w = Window.partitionBy(by).orderBy(order)
    lagged = g.withColumns({f"_l{j}": F.coalesce(F.lag("_g", j).over(w), F.lit(0.0)) for j in range(1, lag + 1)})
    meat: Column = F.sum(F.col("_g") * F.col("_g"))
    for j in range(1, lag + 1):
        meat = meat + 2 * (1 - j / (lag + 1)) * F.sum(F.col("_g") * F.col(f"_l{j}"))
    out = lagged.groupBy(by, "slope", "intercept", "n").agg((F.sqrt(meat) / F.sum(F.col("_c") * F.col("_c"))).alias("se"))
    return out.withColumn("t", F.col("slope") / F.col("se")).withColumn("p", normal_tail(F.col("t")))


def tercile_spread(df: DataFrame, by: str, signal: str, target: str) -> DataFrame:
    """Median of the target in the signal's top third less that in its bottom third."""
    cuts = df.groupBy(by).agg(F.percentile(signal, 1 / 3).alias("_lo"), F.percentile(signal, 2 / 3).alias("_hi"))
    both = df.join(cuts, by)
    top, low = F.median(F.when(F.col(signal) >= F.col("_hi"), F.col(target))), F.median(F.when(F.col(signal) <= F.col("_lo"), F.col(target)))
    return both.groupBy(by).agg((top - low).alias("tercile_spread"))


def fit_two(df: DataFrame, by: str, y: str, a: str, b: str) -> DataFrame:
    """Least squares of y on two regressors and a constant, from sums alone."""
    known = df.where(F.col(y).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull())
    m = known.groupBy(by).agg(
        F.var_pop(a).alias("aa"), F.var_pop(b).alias("bb"), F.covar_pop(a, b).alias("ab"), F.covar_pop(a, y).alias("ay"), F.covar_pop(b, y).alias("by_"), F.var_pop(y).alias("yy"),
        F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.avg(y).alias("my"), F.count(F.lit(1)).alias("n"),
    )
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    m = m.withColumn("slope_a", (F.col("ay") * F.col("bb") - F.col("by_") * F.col("ab")) / det).withColumn("slope_b", (F.col("by_") * F.col("aa") - F.col("ay") * F.col("ab")) / det)
    fitted = F.col("slope_a") * F.col("ay") + F.col("slope_b") * F.col("by_")
    return m.select(by, "n", "slope_a", "slope_b", (F.col("my") - F.col("slope_a") * F.col("ma") - F.col("slope_b") * F.col("mb")).alias("intercept"), (fitted / F.col("yy")).alias("r2"))


def predictive_grid(df: DataFrame, by: str, order: str, signals: list[str], target: str, horizons: list[int]) -> DataFrame:
    """Rank correlation of each signal with the target each horizon ahead, in long form."""
    w = Window.partitionBy(by).orderBy(order)
    ahead = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lead(target, h).over(w).alias("y")) for h in horizons])
    long = df.withColumn("_a", ahead).unpivot([by, order, "_a"], signals, "signal", "x")
    cells = long.select(F.concat_ws("|", by, "signal").alias("_c"), by, "signal", "x", F.explode("_a").alias("t")).select("_c", by, "signal", "x", "t.horizon", "t.y")
    cells = cells.withColumn("cell", F.concat_ws("|", "_c", F.col("horizon").cast("string")))
    names = cells.select("cell", by, "signal", "horizon").distinct()
    return spearman(cells, "cell", "x", "y").join(names, "cell").drop("cell")
