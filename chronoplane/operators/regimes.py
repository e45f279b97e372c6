"""Regimes under composite labels: closed runs, the running one, and its place among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoplane.operators.audit import runs


def composite_label(mode: Column, cluster: Column) -> Column:
    """``mode`` alone, or ``mode:k<cluster>`` where the cluster is known."""
    return F.when(cluster.isNull(), mode).otherwise(F.concat(mode, F.lit(":k"), cluster.cast("int").cast("string")))


def labelled_runs(df: DataFrame, key: str, order: list[str], mode: str, cluster: str) -> DataFrame:
    """Runs of equal composite labels: (key, run, label, mode, cluster, start, finish, steps, is_open).

    The last run of a key is open: how long it will last isn't known yet.
    """
    named = df.withColumn("_label", F.struct(composite_label(F.col(mode), F.col(cluster)).alias("label"), F.col(mode).alias("mode"), F.col(cluster).cast("int").alias("cluster")))
    made = runs(named, key, order, "_label")
    last = made.groupBy(key).agg(F.max("run").alias("_last"))
    out = made.join(last, key)
    return out.select(key, "run", "_label.label", "_label.mode", "_label.cluster", "start", "finish", "steps", (F.col("run") == F.col("_last")).alias("is_open"))


def duration_summary(made: DataFrame) -> DataFrame:
    """Per label, mode and cluster: all runs' durations, those of closed ones apart, and the latest run.

    The latest run of a label ends last; of several, that which began last and is the
    longest.  Durations of closed runs are null where a label has none.
    """
    closed = lambda f: f(F.when(~F.col("is_open"), F.col("steps")))
    latest = F.max(F.struct("finish", "start", "steps"))
    out = made.groupBy("label", "mode", "cluster").agg(
        F.count(F.lit(1)).alias("run_count"), F.min("steps").alias("min_steps"), F.median("steps").alias("median_steps"), F.avg("steps").alias("mean_steps"), F.max("steps").alias("max_steps"),
        F.count_if(~F.col("is_open")).alias("closed_count"), closed(F.median).alias("closed_median"), closed(F.max).alias("closed_max"), latest.alias("l"),
    )
    return out.select(*[c for c in out.columns if c != "l"], F.col("l.start").alias("latest_start"), F.col("l.finish").alias("latest_finish"), F.col("l.steps").alias("latest_steps"))


def running_regimes(made: DataFrame, key: str) -> DataFrame:
    """Each key's open run, and the share of closed runs of its label that were no longer.

    Closed runs are counted by label and length first, so the shares are sums over a
    small table, not comparisons of runs; a label without closed runs has no share.
    """
    counts = made.where("NOT is_open").groupBy("label", "steps").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("label").orderBy("steps")
    upto = counts.select("label", "steps", F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("n").over(Window.partitionBy("label")).alias("closed"))
    running = made.where("is_open").select(key, "label", "mode", "cluster", "start", "finish", "steps")
    lengths = running.select("label", "steps").distinct().select("label", F.col("steps").alias("own"))
    # Few pairs of label and length; the longest closed run within each gives its share.
    near = lengths.join(upto, "label").groupBy("label", "own").agg(F.max(F.when(F.col("steps") <= F.col("own"), F.col("upto"))).alias("upto"), F.max("closed").alias("closed"))
    met = running.join(near.withColumnRenamed("own", "steps"), ["label", "steps"], "left")
    share = F.when(F.col("closed").isNotNull(), F.coalesce("upto", F.lit(0)) / F.col("closed"))
    return met.select(key, "label", "mode", "cluster", "start", "finish", "steps", F.coalesce("closed", F.lit(0)).cast("long").alias("closed_runs"), share.alias("percentile"))
