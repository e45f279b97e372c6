"""Rolling statistics with explicit rules for missing values.

A gated statistic needs every row of its frame; an ungated one starts with the
first row.  Baselines that must not see the current row end one row before it.
Every window is partitioned by a key.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

EPS = 1e-12


class Frames:
    """Frames of one keyed series."""

    def __init__(self, key: str, order: str):
        self._by = Window.partitionBy(key).orderBy(order)

    @property
    def order(self) -> WindowSpec:
        return self._by

    def last(self, n: int) -> WindowSpec:
        return self._by.rowsBetween(-(n - 1), 0)

    def prior(self, n: int) -> WindowSpec:
        return self._by.rowsBetween(-n, -1)

    def lag(self, x: Column, k: int = 1) -> Column:
        return F.lag(x, k).over(self._by)

    def delta(self, x: Column, k: int) -> Column:
        return x - self.lag(x, k)

    def gated(self, value: Column, x: Column, frame: WindowSpec, n: int) -> Column:
        """``value`` where the frame holds n known values of x."""
        return F.when(F.count(x).over(frame) == n, value)

    def mean(self, x: Column, n: int) -> Column:
        return self.gated(F.avg(x).over(self.last(n)), x, self.last(n), n)

    def deviation(self, x: Column, n: int) -> Column:
        """Distance from the gated moving average, as a share of it."""
        return x / self.mean(x, n) - 1

    def realized_vol(self, price: Column, n: int = 20, periods: int = 52) -> Column:
        step = F.log(price / self.lag(price))
        return self.gated(F.stddev_samp(step).over(self.last(n)), step, self.last(n), n) * F.sqrt(F.lit(float(periods)))

    def median_prior(self, x: Column, n: int) -> Column:
        return self.gated(F.percentile(x, 0.5).over(self.prior(n)), x, self.prior(n), n)

    def robust_z(self, x: Column, n: int, eps: float = EPS) -> Column:
        """Distance from the prior median in units of the prior absolute deviation."""
        held = F.collect_list(x).over(self.prior(n))
        return self.gated((x - F.percentile(x, 0.5).over(self.prior(n))) / (1.4826 * array_mad(held) + eps), x, self.prior(n), n)

    def percentile_rank(self, x: Column, n: int) -> Column:
        """Share of known values in the frame, the current one included, that are <= x."""
        held = F.collect_list(x).over(self.last(n))
        return F.when(x.isNotNull(), F.size(F.filter(held, lambda v: v <= x)) / F.size(held))

    def quantile(self, x: Column, n: int, q: float) -> Column:
        return F.percentile(x, q).over(self.last(n))

    def mad_scale(self, x: Column, n: int) -> Column:
        held = F.collect_list(x).over(self.last(n))
        return F.when(F.size(held) > 0, 1.4826 * array_mad(held))


def array_median(values: Column) -> Column:
    """The median of an array without nulls; null when empty."""
    ordered = F.array_sort(values)
    return F.when(F.size(values) > 0, (F.get(ordered, F.floor((F.size(values) - 1) / 2).cast("int")) + F.get(ordered, F.floor(F.size(values) / 2).cast("int"))) / 2)


def array_mad(values: Column) -> Column:
    """Median distance of an array's values from their median."""
    centre = array_median(values)
    # The centre is bound as a lambda's argument, so it is computed once, not per value.
    return F.get(F.transform(F.array(centre), lambda m: array_median(F.transform(values, lambda v: F.abs(v - m)))), F.lit(0))


def weighted_median(pairs: Column) -> Column:
    """The least v of structs (v, w) whose running weight reaches half of the total."""
    ordered = F.array_sort(F.filter(pairs, lambda p: p["v"].isNotNull() & p["w"].isNotNull() & (p["w"] > 0)))
    total = F.aggregate(ordered, F.lit(0.0), lambda acc, p: acc + p["w"])
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("v"))
    return F.get(
        F.transform(
            F.array(total),
            lambda t: F.aggregate(
                ordered,
                zero,
                lambda acc, p: F.struct((acc["sum"] + p["w"]).alias("sum"), F.when(acc["v"].isNotNull(), acc["v"]).when(acc["sum"] + p["w"] >= 0.5 * t, p["v"]).alias("v")),
                lambda acc: acc["v"],
            ),
        ),
        F.lit(0),
    )


def exo_pretransform(x: Column) -> Column:
    return F.when(x.isNotNull(), F.log1p(F.greatest(x, F.lit(0.0))))


def logistic(x: Column) -> Column:
    """The logistic function without overflow on either side."""
    small = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + small)).otherwise(small / (1 + small))
