"""Health of a replay, labels of its clusters, coverage of windows and sources, and exact digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LEVELS = {"p01": 0.01, "p05": 0.05, "p50": 0.50, "p95": 0.95, "p99": 0.99}
#: Share of a window's rows that must be known.
COVERED = 0.95


def finite(c: str) -> Column:
    x = F.col(c).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def health_distributions(replay: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """Per key and metric the number of known values and five quantiles."""
    long = replay.select(key, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot([key], metrics, "metric", "value").where("value IS NOT NULL AND NOT isnan(value)")
    return long.groupBy(key, "metric").agg(F.count(F.lit(1)).alias("n"), *[F.percentile("value", p).alias(name) for name, p in LEVELS.items()])


def health_counts(replay: DataFrame, key: str) -> DataFrame:
    """Per key: rows, warm and warm-up rows, drift flags, and how often states degrade, floors act and weights shrink."""
    share = lambda c: F.count_if(c) / F.count(F.lit(1))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return replay.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(~yes("is_warm")).alias("warmup_rows"), F.count_if(yes("is_warm")).alias("warm_rows"), F.coalesce(F.sum("drift_flag"), F.lit(0)).cast("long").alias("drift_flag_count"),
        share(yes("floored")).alias("floored_frequency"), share(~yes("state_ok")).alias("degradation_frequency"), share(F.coalesce(F.col("huber_weight") < 1.0, F.lit(False))).alias("huber_below_1_frequency"),
    )


def around_boundary(replay: DataFrame, key: str, order: str, rows: int = 10) -> DataFrame:
    """The rows up to ``rows`` before and after each key's first warm row, with their offset from it."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    first = F.min(F.when(F.col("is_warm"), F.col("_i"))).over(Window.partitionBy(key))
    return replay.withColumn("_i", place).withColumn("offset", F.col("_i") - first).where(F.abs("offset") <= rows).drop("_i")


def window_coverage(replay: DataFrame, windows: DataFrame, key: str, day: str, columns: list[str], source_end: Column | None = None) -> DataFrame:
    """Per key and named window (name, start, end): rows, known values, whether enough of the first column is known.

    ``source_end`` is the last day of the source; a window that outlives it isn't covered.
    The windows are few; each day is compared with all of them.
    """
    every = windows.select(F.collect_list(F.struct("name", "start", "end")).alias("_w"))
    rows = replay.select(key).distinct().join(F.broadcast(every)).select(key, F.explode("_w").alias("w")).select(key, F.col("w.name").alias("window"), F.col("w.start").alias("_s"), F.col("w.end").alias("_e"))
    hit = replay.select(key, day, *columns).join(rows, key).where(F.col(day).between(F.col("_s"), F.col("_e")))
    sums = hit.groupBy(key, "window").agg(F.count(F.lit(1)).alias("rows_total"), *[F.count_if(finite(c)).alias(f"rows_finite_{c}") for c in columns], F.max(day).alias("_last"))
    out = rows.join(sums, [key, "window"], "left").na.fill(0, ["rows_total", *[f"rows_finite_{c}" for c in columns]])
    enough = (F.col("rows_total") > 0) & (F.col(f"rows_finite_{columns[0]}") >= COVERED * F.col("rows_total"))
    late = F.lit(False) if source_end is None else F.coalesce(source_end < F.coalesce("_last", F.col("_e")), F.lit(False))
    status = F.when(late, "incomplete_due_to_source_coverage").when(enough, "ok").otherwise("incomplete")
    return out.select(key, "window", "rows_total", *[f"rows_finite_{c}" for c in columns], (enough & ~late).alias("coverage_ok"), status.alias("window_status"))


def semantic_labels(centres: DataFrame, key: str) -> DataFrame:
    """Add label to the five clusters (cluster, h, i) of each key.

    By level the two lowest are S1 and S2, the lower impulse first; the middle is
    S3; of the two highest the one with the higher impulse is S4.  Ties go to the
    smaller cluster.
    """
    by = Window.partitionBy(key).orderBy("h", "cluster")
    band = F.when(F.col("_r") <= 2, 0).when(F.col("_r") == 3, 1).otherwise(2)
    ranked = centres.withColumn("_r", F.row_number().over(by)).withColumn("_band", band)
    within = F.row_number().over(Window.partitionBy(key, "_band").orderBy(F.when(F.col("_band") == 2, -F.col("i")).otherwise(F.col("i")), "_r"))
    label = F.when(F.col("_band") == 1, "S3").otherwise(F.concat(F.lit("S"), (F.when(F.col("_band") == 0, 0).otherwise(3) + F.col("_q")).cast("string")))
    return ranked.withColumn("_q", within).withColumn("label", label).drop("_r", "_band", "_q")


def first_state(rows: DataFrame, key: str, n_clusters: int = 5) -> DataFrame:
    """Per key the cluster with the lower median impulse among the two of lowest median level; null unless all are there."""
    known = rows.where(F.col("cluster").isNotNull() & finite("h") & finite("i"))
    medians = known.groupBy(key, "cluster").agg(F.median("h").alias("h"), F.median("i").alias("i"))
    low = medians.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("h", "cluster")))
    return low.groupBy(key).agg(F.when(F.count(F.lit(1)) >= n_clusters, F.min_by(F.when(F.col("_r") <= 2, F.col("cluster")), F.when(F.col("_r") <= 2, F.struct("i", "cluster")))).alias("s1_cluster"), F.count(F.lit(1)).alias("n_clusters"))


def source_gaps(series: DataFrame, key: str, name: str, value: str, required: list[str], least: int) -> DataFrame:
    """Per key the required series without a value, and those with fewer than ``least``; in the order required."""
    counts = series.groupBy(key, name).agg(F.count(value).alias("n")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(name, "n"))).alias("_n"))
    n = lambda s: F.coalesce(F.col("_n")[s], F.lit(0))
    return counts.select(key, F.concat_ws(",", *[F.when(n(s) == 0, F.lit(s)) for s in required]).alias("missing"), F.concat_ws(",", *[F.when((n(s) > 0) & (n(s) < least), F.lit(s)) for s in required]).alias("insufficient"))


def frame_digest(df: DataFrame, by: list[str], columns: list[str], order: list[str]) -> DataFrame:
    """Per group the digest of its rows as comma-separated text, columns by name, a header first, nulls empty.

    One group is one record; it is meant for master data.  Values must hold no commas or quotes.
    """
    names = sorted(columns)
    line = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names])
    rows = df.select(*by, F.struct(*order).alias("_o"), line.alias("_l")).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_l"))), lambda x: x["_l"]).alias("_t"))
    text = F.concat(F.lit(",".join(names) + "\n"), F.array_join("_t", "\n"), F.lit("\n"))
    return rows.select(*by, F.size("_t").alias("n_rows"), F.sha2(text, 256).alias("digest"))


def weights_at(facts: DataFrame, keys: list[str], known_at: str, place: str, weight: str, asof: Column) -> DataFrame:
    """Per key the weight of the last row of the file that was known at ``asof``."""
    return facts.where(F.col(known_at) <= asof).groupBy(*keys).agg(F.max_by(weight, place).alias(weight))


def strict_days(days: DataFrame, members: DataFrame, weights: DataFrame, windows: DataFrame, day: str, member: str, weight: str) -> DataFrame:
    """Per day whether it is eligible and what blocks it.

    A day without members is blocked by that alone.  Weights must sum to one
    within a hundredth, some member must have one, and each weighted member needs a
    full price window.
    """
    held = members.select(day, member).distinct()
    sums = weights.groupBy(day).agg(F.sum(weight).alias("_sum"))
    good = sums.where(F.abs(F.col("_sum") - 1) <= 0.01).select(day, F.lit(True).alias("_good"))
    used = held.join(weights.where(F.col(weight) > 0).select(day, member), [day, member], "left_semi").join(good, day, "left_semi")
    priced = windows.select(day, member).distinct().withColumn("_p", F.lit(True))
    facts = used.join(priced, [day, member], "left").groupBy(day).agg(F.count(F.lit(1)).alias("_used"), F.count_if(F.col("_p").isNull()).alias("_bare"))
    out = days.select(day).distinct().join(held.groupBy(day).agg(F.count(F.lit(1)).alias("_n")), day, "left").join(good, day, "left").join(facts, day, "left")
    none = F.col("_n").isNull()
    blockers = F.concat_ws(
        ",",
        F.when(none, "historical_constituent_coverage_incomplete"),
        F.when(~none & (F.col("_good").isNull() | F.col("_used").isNull()), "historical_weight_coverage_incomplete"),
        F.when(F.col("_bare") > 0, "pit_coverage_incomplete,rename_identity_coverage_incomplete"),
    )
    return out.select(day, blockers.alias("blockers"), (blockers == "").alias("eligible"))
