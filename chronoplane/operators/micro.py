"""Cross-sectional measures per day: membership, smoothed weights, breadth, correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoplane.functions.recursions import decay
from chronoplane.operators.rolling import logistic, weighted_median


def day_ordinals(panel: DataFrame, day: str) -> DataFrame:
    """A running number of the days that have a snapshot; one row per day."""
    days = panel.select(day).distinct().withColumn("_g", F.lit(0))
    return days.withColumn("ordinal", F.row_number().over(Window.partitionBy("_g").orderBy(day))).drop("_g")


def member_ages(panel: DataFrame, day: str, member: str, grace: int = 3) -> DataFrame:
    """Age of each member present: its presences since it was last gone for more than ``grace`` days."""
    seen = panel.join(day_ordinals(panel, day), day)
    by = Window.partitionBy(member).orderBy("ordinal")
    fresh = F.when(F.col("ordinal") - F.lag("ordinal").over(by) - 1 > grace, 1).otherwise(0)
    spans = seen.withColumn("_f", fresh).withColumn("span", F.sum("_f").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_f")
    return spans.withColumn("age", F.row_number().over(Window.partitionBy(member, "span").orderBy("ordinal")))


def mature_counts(ages: DataFrame, day: str, first: int = 20, second: int = 60) -> DataFrame:
    return ages.groupBy(day).agg(F.count_if(F.col("age") >= first).alias("n_first"), F.count_if(F.col("age") >= second).alias("n_second"), F.count(F.lit(1)).alias("n_members"))


def missing_weight_guard(ages: DataFrame, panel: DataFrame, day: str, member: str, weight: str, grace: int = 3) -> DataFrame:
    """Per day: weight of members in grace, the fifth largest present weight, and whether to hold.

    A member is in grace on the days after its last presence, up to ``grace``.
    """
    by = Window.partitionBy(member).orderBy("ordinal")
    gaps = ages.withColumn("_next", F.coalesce(F.lead("ordinal").over(by), F.col("ordinal") + grace + 1))
    away = gaps.withColumn("_o", F.explode(F.expr(f"filter(sequence(ordinal + 1, ordinal + {grace}), o -> o < _next)")))
    lost = away.groupBy(F.col("_o").alias("ordinal")).agg(F.sum(weight).alias("missing"))
    fifth = panel.groupBy(day).agg(F.get(F.sort_array(F.collect_list(weight), asc=False), F.lit(4)).alias("fifth"))
    out = day_ordinals(panel, day).join(lost, "ordinal", "left").join(fifth, day)
    missing = F.coalesce("missing", F.lit(0.0))
    return out.select(day, missing.alias("missing"), "fifth", F.coalesce(missing > 0.5 * F.col("fifth"), F.lit(False)).alias("hold"))


def dense(panel: DataFrame, day: str, member: str, weight: str) -> DataFrame:
    """Every day for every member; a missing weight is 0."""
    days, members = panel.select(day).distinct(), panel.select(member).distinct()
    return days.join(members, how="cross").join(panel.select(day, member, weight), [day, member], "left").na.fill(0.0, [weight])


def breadth(panel: DataFrame, day: str, member: str, price: str, weight: str, n: int) -> DataFrame:
    """One less the weighted share of members above their moving average."""
    last = Window.partitionBy(member).orderBy(day).rowsBetween(-(n - 1), 0)
    ready = panel.withColumn("_ma", F.when(F.count(price).over(last) == n, F.avg(price).over(last))).where("_ma IS NOT NULL")
    share = F.sum(F.when(F.col(price) > F.col("_ma"), F.col(weight)).otherwise(0.0)) / F.sum(weight)
    return ready.groupBy(day).agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - share)).alias("breadth"))


def concentration(panel: DataFrame, day: str, member: str, price: str, weight: str, n: int) -> DataFrame:
    """Weighted mean correlation off the diagonal, over the last n returns of each member.

    The double sum over pairs is the variance of the weighted sum of standardised
    returns, so two aggregations replace the pairs.  Members need all n returns,
    on the same days, and a spread.
    """
    ordered = panel.join(day_ordinals(panel, day), day)
    by = Window.partitionBy(member).orderBy("ordinal")
    step = ordered.withColumn("_r", F.when(F.col("ordinal") - F.lag("ordinal").over(by) == 1, F.col(price) / F.lag(price).over(by) - 1))
    last = by.rowsBetween(-(n - 1), 0)
    held = step.withColumn("_w", F.collect_list(F.when(F.col("_r").isNotNull(), F.struct(F.col("ordinal").alias("o"), F.col("_r").alias("r")))).over(last))
    held = held.withColumn("_sd", F.stddev_samp("_r").over(last)).withColumn("_mean", F.avg("_r").over(last)).withColumn("_first", F.get("_w", F.lit(0))["o"])
    full = held.where((F.size("_w") == n) & (F.col("ordinal") - F.col("_first") == n - 1) & (F.col("_sd") > 0))
    full = full.withColumn("_share", F.col(weight) / F.sum(weight).over(Window.partitionBy(day)))
    z = full.select(day, "_share", F.explode("_w").alias("x"), "_mean", "_sd").withColumn("z", F.col("_share") * (F.col("x.r") - F.col("_mean")) / F.col("_sd"))
    total = z.groupBy(day, "x.o").agg(F.sum("z").alias("z")).groupBy(day).agg(F.var_samp("z").alias("v"))
    squares = full.groupBy(day).agg(F.sum(F.col("_share") * F.col("_share")).alias("s"), F.count(F.lit(1)).alias("n_members"))
    return total.join(squares.where("n_members > 1"), day).select(day, "n_members", ((F.col("v") - F.col("s")) / (1 - F.col("s") + 1e-12)).alias("concentration"))


def membership_changes(ages: DataFrame, day: str, member: str) -> DataFrame:
    """Per day whether its members differ from those of the day before, and whether any member is in grace."""
    by = Window.partitionBy(member).orderBy("ordinal")
    stayed = ages.withColumn("_stayed", (F.col("ordinal") - F.lag("ordinal").over(by) == 1).cast("int"))
    counts = stayed.groupBy(day, "ordinal").agg(F.count(F.lit(1)).alias("_n"), F.coalesce(F.sum("_stayed"), F.lit(0)).alias("_kept"))
    # One row per day: their order needs one task.
    days = Window.partitionBy(F.lit(0)).orderBy("ordinal")
    before = F.lag("_n").over(days)
    return counts.select(day, "ordinal", F.coalesce((F.col("_n") != before) | (F.col("_kept") != before), F.lit(False)).alias("changed"))


def in_grace(ages: DataFrame, member: str, grace: int = 3) -> DataFrame:
    """(ordinal, member) on the days after a member's last presence, up to ``grace`` and its return."""
    by = Window.partitionBy(member).orderBy("ordinal")
    gaps = ages.select(member, "ordinal", F.coalesce(F.lead("ordinal").over(by), F.col("ordinal") + grace + 1).alias("_next"))
    return gaps.select(member, F.explode(F.expr(f"filter(sequence(ordinal + 1, ordinal + {grace}), o -> o < _next)")).alias("ordinal"))


def common_concentration(held: DataFrame, day: str, member: str) -> DataFrame:
    """(day, c): weighted mean correlation off the diagonal of each day's members.

    ``held`` has a row per day and member with its weight v and the window w of
    (ordinal, price).  Returns count on days on which all members have one.  Fewer
    than two members or returns, or a member without spread, give null.
    """
    pairs = F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.when(b["ordinal"] - a["ordinal"] == 1, F.struct(b["ordinal"].alias("o"), (b["price"] / a["price"] - 1).alias("r"))))
    rows = held.select(day, "v", F.filter(pairs, lambda x: x.isNotNull()).alias("_x"))
    total = F.col("_total") + 1e-12
    sizes = held.groupBy(day).agg(F.count(F.lit(1)).alias("_m"), F.sum("v").alias("_total"), F.sum(F.col("v") * F.col("v")).alias("_squares"))
    # One short row per day: what all its members have.  A member's returns never leave its row.
    met = rows.select(day, F.explode("_x.o").alias("_o")).groupBy(day, "_o").agg(F.count(F.lit(1)).alias("_k"))
    common = met.join(sizes.where("_m > 1"), day).where("_k = _m").groupBy(day, "_total", "_squares").agg(F.collect_set("_o").alias("_os")).where(F.size("_os") > 1)
    own = rows.join(F.broadcast(common), day).withColumn("_x", F.filter("_x", lambda x: F.array_contains("_os", x["o"])))
    # Measured from the first return, so that equal ones have no spread at all.
    first, n = F.get("_x", F.lit(0))["r"], F.size("_x")
    own = own.withColumn("_mean", first + F.aggregate(F.transform("_x", lambda x: x["r"] - first), F.lit(0.0), lambda acc, r: acc + r) / n)
    own = own.withColumn("_sd", F.sqrt(F.aggregate("_x", F.lit(0.0), lambda acc, x: acc + (x["r"] - F.col("_mean")) * (x["r"] - F.col("_mean"))) / (n - 1)))
    z = own.select(day, (F.col("v") / total / F.nullif("_sd", F.lit(0.0))).alias("_scale"), "_mean", F.explode("_x").alias("x"))
    z = z.groupBy(day, "x.o").agg(F.count_if(F.col("_scale").isNull() | F.col("x.r").isNull()).alias("_lost"), F.sum(F.col("_scale") * (F.col("x.r") - F.col("_mean"))).alias("_z"))
    spread = z.groupBy(day).agg(F.when(F.sum("_lost") == 0, F.var_samp("_z")).alias("_v")).join(F.broadcast(common), day)
    squares = F.col("_squares") / (total * total)
    return spread.select(day, ((F.col("_v") - squares) / (1 - squares + 1e-12)).alias("c"))


def smoothed_panel(ages: DataFrame, changes: DataFrame, member: str, weight: str, half_life: float = 5) -> tuple[DataFrame, DataFrame]:
    """``ages`` with v, its lagged smoothed weight, and the days on which a known member is absent.

    The recursion of ``SmoothedWeights``, whose rule days are the ``changes`` of all
    members, in closed form: between two presences a weight only decays, by the number
    of days that are no rule days.  Absent days have (ordinal, v, away), the days since
    the last presence.  Sums are scaled by blocks of days, so that a history of any
    length stays within a double; beyond three blocks a weight is below the least one.
    """
    rate, kept, block = 1 / half_life, decay(half_life), int(400 * half_life)
    by_day = Window.partitionBy(F.lit(0)).orderBy("ordinal")
    steps = changes.select("ordinal", F.when(~F.col("changed") & (F.col("ordinal") > 1), 1).otherwise(0).alias("_moves"))
    # One row per day, as in the changes.
    steps = steps.withColumn("_k", F.sum("_moves").over(by_day.rowsBetween(Window.unboundedPreceding, 0)))
    steps = steps.select("ordinal", "_k", F.coalesce(F.lead("_moves").over(by_day), F.lit(0)).alias("_moves"), F.max("ordinal").over(Window.partitionBy(F.lit(0))).alias("_end"))
    faded = lambda days: F.pow(F.lit(2.0), -rate * days)
    own = Window.partitionBy(member, "_block").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda n: Window.partitionBy(member).orderBy("_block").rangeBetween(-n, -n)
    rows = ages.join(F.broadcast(steps), "ordinal").withColumn("_block", F.floor(F.col("_k") / block))
    since = F.col("_k") - F.col("_block") * block
    rows = rows.withColumn("_w", F.coalesce(weight, F.lit(0.0)) * F.col("_moves")).withColumn("_t", F.col("_w") / faded(since + 1))
    rows = rows.withColumns({"_s0": F.coalesce(F.sum("_t").over(own), F.lit(0.0)), **{f"_s{n}": F.coalesce(F.sum("_t").over(earlier(n)), F.lit(0.0)) for n in (1, 2)}})
    rows = rows.withColumn("v", (1 - kept) * (F.col("_s0") + F.col("_s1") * 2.0 ** (-rate * block) + F.col("_s2") * 2.0 ** (-2 * rate * block)) * faded(since))
    after = F.col("v") * faded(F.col("_moves")) + (1 - kept) * F.col("_w")
    upto = F.coalesce(F.lead("ordinal").over(Window.partitionBy(member).orderBy("ordinal")) - 1, F.col("_end"))
    gaps = rows.select("ordinal", (F.col("_k") + F.col("_moves")).alias("_from"), after.alias("_v"), upto.alias("_upto")).where("_upto > ordinal")
    gaps = gaps.select("ordinal", "_from", "_v", F.explode(F.sequence(F.col("ordinal") + 1, "_upto")).alias("_o"))
    gaps = gaps.join(F.broadcast(steps.select(F.col("ordinal").alias("_o"), "_k")), "_o")
    absent = gaps.select(F.col("_o").alias("ordinal"), (F.col("_v") * faded(F.col("_k") - F.col("_from"))).alias("v"), (F.col("_o") - F.col("ordinal")).alias("away"))
    return rows.select(*ages.columns, "v"), absent


def daily_frame(panel: DataFrame, day: str, member: str, price: str, weight: str, young: int = 20, old: int = 60, grace: int = 3) -> DataFrame:
    """Per day breadth b, concentration c, z_weight and hold.

    Members count for b from age ``young`` and for c from age ``old``, over windows of as
    many prices, under lagged smoothed weights.  Days whose members changed, or on
    which a member is in grace, weigh 0.3.  A day that lacks too much weight holds
    the last values.  The first day has none.
    """
    ages = member_ages(panel, day, member, grace)
    changes = membership_changes(ages, day, member)
    present, absent = smoothed_panel(ages, changes, member, weight)
    away = absent.where(F.col("away") <= grace).groupBy("ordinal").agg(F.sum("v").alias("_lost"), F.count(F.lit(1)).alias("_away"))
    # A member is in the ranking from its first lagged weight on.
    place = F.row_number().over(Window.partitionBy("ordinal").orderBy(F.desc("v")))
    ranked = present.select("ordinal", "v").unionByName(absent.select("ordinal", "v")).where("v > 0").withColumn("_place", place)
    fifth = ranked.where("_place <= 5").where("_place = 5").select("ordinal", F.col("v").alias("_fifth"))
    last = lambda n: Window.partitionBy(member).orderBy("ordinal").rowsBetween(-(n - 1), 0)
    held = present.withColumns({"_ma": F.avg(price).over(last(young)), "w": F.collect_list(F.struct("ordinal", F.col(price).alias("price"))).over(last(old))}).where("v > 0")
    b = held.where(F.col("age") >= young).groupBy(day).agg(F.sum("v").alias("_t"), F.sum(F.when(F.col(price) > F.col("_ma"), F.col("v")).otherwise(0.0)).alias("_u"))
    raw = 1 - F.col("_u") / (F.col("_t") + 1e-12)
    b = b.select(day, F.when(F.col("_t") > 1e-12, F.when(F.abs(raw) <= 1e-10, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)))).alias("b"))
    c = common_concentration(held.where(F.col("age") >= old), day, member)
    out = changes.join(away, "ordinal", "left").join(fifth, "ordinal", "left").join(b, day, "left").join(c, day, "left")
    hold = F.coalesce(F.coalesce("_lost", F.lit(0.0)) > 0.5 * F.col("_fifth"), F.lit(False))
    out = out.withColumn("hold", hold & (F.col("ordinal") > 1)).withColumn("z_weight", F.when((F.col("ordinal") > 1) & (F.col("changed") | F.col("_away").isNotNull() | F.col("hold")), 0.3).otherwise(1.0))
    upto = Window.partitionBy(F.lit(0)).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    own = lambda x: F.when(~F.col("hold") & (F.col("ordinal") > 1), F.col(x))
    out = out.withColumns({"_b": own("b"), "_c": own("c")})
    carried = lambda x: F.when(F.col("hold"), F.last(x, ignorenulls=True).over(upto)).otherwise(F.col(x))
    return out.select(day, carried("_b").alias("b"), carried("_c").alias("c"), "z_weight", "hold")


def weekly_score(daily: DataFrame, week: str, window: int = 156) -> DataFrame:
    """(week, b, c, z_weight, h): weekly medians, the least weight of the week, and the score of both robust scores.

    Each score measures a week by the weighted median and deviation of the weeks before it.
    """
    weeks = daily.groupBy(week).agg(F.median("b").alias("b"), F.median("c").alias("c"), F.min("z_weight").alias("z_weight"))
    prior = Window.partitionBy(F.lit(0)).orderBy(week).rowsBetween(-window, -1)
    held = weeks.withColumns({f"_{x}": F.filter(F.collect_list(F.struct(F.col(x).alias("v"), F.col("z_weight").alias("w"))).over(prior), lambda p: p["v"].isNotNull()) for x in ("b", "c")})

    def distances(x: str) -> Column:
        return F.transform(f"_{x}", lambda p: F.struct(F.abs(p["v"] - F.col(f"_m{x}")).alias("v"), p["w"].alias("w")))

    for x in ("b", "c"):
        held = held.withColumn(f"_m{x}", weighted_median(F.col(f"_{x}")))
        held = held.withColumn(f"_s{x}", weighted_median(distances(x)))
        held = held.withColumn(f"_z{x}", (F.col(x) - F.col(f"_m{x}")) / (1.4826 * F.col(f"_s{x}") + 1e-12))
    return held.select(week, "b", "c", "z_weight", logistic(0.5 * F.col("_zb") + 0.5 * F.col("_zc")).alias("h"))
