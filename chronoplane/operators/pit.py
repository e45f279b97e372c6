"""Point-in-time lookups: as-of joins, bitemporal reads, adjusted windows, renames.

As-of joins are one union and one window per key instead of a range join: every
row is read once whatever the distance to its match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _sided(left: DataFrame, right: DataFrame, key: str, ts: str, values: list[str]) -> DataFrame:
    asked = left.select(F.struct("*").alias("l"), F.col(key).alias("_k"), F.col(ts).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(F.struct(ts, *values)).schema[0].dataType).alias("r"))
    known = right.select(F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("l"), F.col(key).alias("_k"), F.col(ts).alias("_t"), F.lit(0).alias("_side"), F.struct(ts, *values).alias("r"))
    return known.unionByName(asked)


def _unfolded(df: DataFrame, left: DataFrame, ts: str, values: list[str], match: Column, within: Column | None) -> DataFrame:
    hit = df.where("_side = 1").withColumn("_m", match)
    if within is not None:
        hit = hit.withColumn("_m", F.when(within, F.col("_m")))
    return hit.select(*[F.col("l").getField(c).alias(c) for c in left.columns], F.col("_m").getField(ts).alias(f"matched_{ts}"), *[F.col("_m").getField(v).alias(v) for v in values])


def asof_backward(left: DataFrame, right: DataFrame, key: str, ts: str, values: list[str], max_staleness: str | None = None) -> DataFrame:
    """The latest row of ``right`` at or before each row of ``left``.

    ``max_staleness`` is an interval; an older match counts as none.
    """
    upto = Window.partitionBy("_k").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = _sided(left, right, key, ts, values).withColumn("_last", F.last("r", ignorenulls=True).over(upto))
    within = None if max_staleness is None else F.col("_m").getField(ts) >= F.col("_t") - F.expr(f"interval {max_staleness}")
    return _unfolded(both, left, ts, values, F.col("_last"), within)


def asof_frame(left: DataFrame, right: DataFrame, key: str, ts: str, limits: dict[str, str | None], span: str = "quarter") -> DataFrame:
    """Every column's own latest known value at or before each row of ``left``.

    ``limits`` maps the columns to intervals (or None): a value that is older than
    its column's limit counts as none.  Each comes with ``<column>_at``, the time it
    was observed.  Of several rows of a key at one time the largest known value
    counts.  A key's time is cut into spans, each a window of its own; what was known
    before a span is carried in from one row per span, so a long or hot key isn't one
    task's work.
    """
    known = right.groupBy(F.col(key).alias("_k"), F.col(ts).alias("_t")).agg(*[F.max(c).alias(c) for c in limits])
    known = known.select("_k", "_t", F.lit(0).alias("_side"), *[F.when(F.col(c).isNotNull(), F.struct(F.col("_t").alias("at"), F.col(c).alias("v"))).alias(f"_{c}") for c in limits])
    asked = left.select(F.struct("*").alias("_l"), F.col(key).alias("_k"), F.col(ts).alias("_t"), F.lit(1).alias("_side"))
    both = known.unionByName(asked, allowMissingColumns=True).withColumn("_s", F.date_trunc(span, "_t"))
    ends = both.groupBy("_k", "_s").agg(*[F.max(f"_{c}").alias(f"_{c}") for c in limits])
    earlier = Window.partitionBy("_k").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col("_k").alias("_ck"), F.col("_s").alias("_cs"), *[F.last(f"_{c}", ignorenulls=True).over(earlier).alias(f"_c_{c}") for c in limits])
    within = Window.partitionBy("_k", "_s").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    last = both.withColumns({f"_{c}": F.last(f"_{c}", ignorenulls=True).over(within) for c in limits}).where("_side = 1")
    met = last.join(carried, F.col("_k").eqNullSafe(F.col("_ck")) & (F.col("_s") == F.col("_cs")))
    out = []
    for c, limit in limits.items():
        found = F.coalesce(F.col(f"_{c}"), F.col(f"_c_{c}"))
        if limit is not None:
            found = F.when(found["at"] >= F.col("_t") - F.expr(f"interval {limit}"), found)
        out += [found["v"].alias(c), found["at"].alias(f"{c}_at")]
    return met.select(*[F.col("_l").getField(c).alias(c) for c in left.columns], *out)


def asof_forward(left: DataFrame, right: DataFrame, key: str, ts: str, values: list[str], strict: bool = True) -> DataFrame:
    """The earliest row of ``right`` after each row of ``left``, or at it unless strict."""
    order = ["_t", "_side"] if strict else ["_t", F.desc("_side")]
    onward = Window.partitionBy("_k").orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    both = _sided(left, right, key, ts, values).withColumn("_next", F.first("r", ignorenulls=True).over(onward))
    return _unfolded(both, left, ts, values, F.col("_next"), None)


def asof_nearest(left: DataFrame, right: DataFrame, key: str, ts: str, values: list[str], tolerance_days: int) -> DataFrame:
    """The nearest row of ``right`` on either side; a tie goes to the earlier one."""
    upto = Window.partitionBy("_k").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    onward = Window.partitionBy("_k").orderBy("_t", "_side").rowsBetween(0, Window.unboundedFollowing)
    both = _sided(left, right, key, ts, values).withColumn("_b", F.last("r", ignorenulls=True).over(upto)).withColumn("_f", F.first("r", ignorenulls=True).over(onward))
    back, ahead = F.datediff("_t", F.col("_b").getField(ts)), F.datediff(F.col("_f").getField(ts), F.col("_t"))
    match = F.when(back.isNotNull() & (ahead.isNull() | (back <= ahead)), F.col("_b")).otherwise(F.col("_f"))
    within = F.abs(F.datediff("_t", F.col("_m").getField(ts))) <= tolerance_days
    return _unfolded(both, left, ts, values, match, within)


def latest_visible(facts: DataFrame, keys: list[str], known_at: str, value: str, asof: Column) -> DataFrame:
    """Per key the value of the latest vintage that was known at ``asof``."""
    seen = facts.where(F.col(known_at) <= asof)
    return seen.groupBy(*keys).agg(F.max_by(value, F.struct(known_at, value)).alias(value), F.max(known_at).alias(known_at))


def latest_then_checked(facts: DataFrame, keys: list[str], known_at: str, value: str, asof: Column) -> DataFrame:
    """The store's flavour: only the last vintage exists, and it must be known already."""
    last = facts.groupBy(*keys).agg(F.max_by(value, F.struct(known_at, value)).alias(value), F.max(known_at).alias(known_at))
    return last.where(F.col(known_at) <= asof)


def snapshot_members(facts: DataFrame, day: str, member: str, known_at: str, asof: Column) -> DataFrame:
    """Members of each day over all vintages known at ``asof``; a day without any is absent."""
    return facts.where(F.col(known_at) <= asof).groupBy(day).agg(F.count_distinct(member).alias("n_members"), F.sort_array(F.collect_set(member)).alias("members"))


def log_factor_index(actions: DataFrame, key: str, day: str, factor: str) -> DataFrame:
    """Cumulative sum of log factors per key and effective day.

    The product over (a, b] is the difference of two as-of reads of this index,
    so no pair of price and action is ever formed.  Sums are decimals of 20 places, so
    a difference has no error of the history before it.
    """
    daily = actions.groupBy(key, day).agg(F.sum(F.log(factor).cast("decimal(28,20)")).alias("log_factor"))
    upto = Window.partitionBy(key).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    return daily.select(key, day, F.sum("log_factor").over(upto).alias("cum"))


def adjustment_factor(prices: DataFrame, actions: DataFrame, key: str, day: str, factor: str, end_day: str) -> DataFrame:
    """Product of the factors effective in (day, end_day] for each price row; 1 if none."""
    index = log_factor_index(actions, key, day, factor)
    start = asof_backward(prices, index, key, day, ["cum"]).withColumnRenamed("cum", "_c0").drop(f"matched_{day}")
    ends = start.withColumnsRenamed({day: "_day", end_day: day})
    done = asof_backward(ends, index, key, day, ["cum"]).drop(f"matched_{day}").withColumnsRenamed({day: end_day, "_day": day})
    return done.withColumn("factor", F.exp((F.coalesce("cum", F.lit(0)) - F.coalesce("_c0", F.lit(0))).cast("double"))).drop("cum", "_c0")


def adjusted_window(prices: DataFrame, actions: DataFrame, key: str, day: str, price: str, factor: str, n: int) -> DataFrame:
    """The last n prices up to each day, all on that day's basis; days with fewer are absent."""
    index = log_factor_index(actions, key, day, factor)
    based = asof_backward(prices.select(key, day, price), index, key, day, ["cum"]).withColumn("c", F.coalesce("cum", F.lit(0)))
    last = Window.partitionBy(key).orderBy(day).rowsBetween(-(n - 1), 0)
    held = based.withColumn("w", F.collect_list(F.struct(F.col(price).alias("p"), "c")).over(last)).where(F.size("w") == n)
    return held.select(key, day, F.transform("w", lambda x: x["p"] * F.exp((F.col("c") - x["c"]).cast("double"))).alias("window"))


def fixture_close(bars: DataFrame, price: str, factor: str) -> DataFrame:
    """Add adj_close: the price times the cumulative factor of its own day."""
    return bars.withColumn("adj_close", F.col(price) * F.col(factor))


def basis_window(bars: DataFrame, key: str, day: str, price: str, factor: str, n: int, relative: bool) -> DataFrame:
    """(key, day, status, window): the last n prices up to each day on the last bar's basis.

    ``relative`` divides by each bar's own cumulative factor; otherwise one
    constant basis multiplies all.  Fewer bars are ``insufficient_history``.
    """
    last = Window.partitionBy(key).orderBy(day).rowsBetween(-(n - 1), 0)
    held = bars.withColumn("_w", F.collect_list(F.struct(F.col(price).alias("p"), F.col(factor).alias("c"))).over(last))
    price_of = (lambda x: x["p"] * (F.col(factor) / x["c"])) if relative else (lambda x: x["p"] * F.col(factor))
    full = F.size("_w") == n
    return held.select(key, day, F.when(full, "ok").otherwise("insufficient_history").alias("status"), F.when(full, F.transform("_w", price_of)).alias("window"))


def ledger_window(asked: DataFrame, prices: DataFrame, actions: DataFrame, renames: DataFrame, n: int) -> DataFrame:
    """(ticker, end_day, status, window of (symbol, price)) for each (ticker, end_day) asked.

    ``prices`` (symbol, day, raw), ``actions`` (symbol, day, factor) and
    ``renames`` (old_symbol, new_symbol, effective_date) hold what is known.  A day
    before a rename on which the ticker has no price takes the old symbol's.  Each
    price is carried to the end day's basis by its own symbol's factors.
    """
    old = prices.join(renames, F.col("symbol") == F.col("old_symbol")).where(F.col("effective_date") > F.col("day")).select(F.col("new_symbol").alias("ticker"), "symbol", "day", "raw")
    direct = prices.select(F.col("symbol").alias("ticker"), "symbol", "day", "raw")
    own = direct.unionByName(old.join(direct.select("ticker", "day"), ["ticker", "day"], "left_anti"))
    index = log_factor_index(actions, "symbol", "day", "factor")
    based = asof_backward(own, index, "symbol", "day", ["cum"]).withColumn("c", F.coalesce("cum", F.lit(0)))
    last = Window.partitionBy("ticker").orderBy("day").rowsBetween(-(n - 1), 0)
    held = based.select("ticker", "day", F.collect_list(F.struct("day", "symbol", "raw", "c")).over(last).alias("w"))
    found = asof_backward(asked.withColumnRenamed("end_day", "day"), held, "ticker", "day", ["w"]).select("ticker", F.col("day").alias("end_day"), "w").where("w IS NOT NULL")
    each = found.select("ticker", "end_day", F.size("w").alias("n"), F.explode("w").alias("x")).select("ticker", "end_day", "n", F.col("x.day").alias("_day"), "x.symbol", "x.raw", "x.c")
    ends = asof_backward(each.withColumnRenamed("end_day", "day"), index, "symbol", "day", ["cum"])
    price = F.col("raw") * F.exp((F.coalesce("cum", F.lit(0)) - F.col("c")).cast("double"))
    rows = ends.groupBy("ticker", F.col("day").alias("end_day"), "n").agg(F.array_sort(F.collect_list(F.struct("_day", "symbol", price.alias("price")))).alias("_w"))
    full = F.col("n") == n
    return rows.select("ticker", "end_day", F.when(full, "ok").otherwise("insufficient_history").alias("status"), F.when(full, F.transform("_w", lambda x: F.struct(x["symbol"].alias("symbol"), x["price"].alias("price")))).alias("window"))
