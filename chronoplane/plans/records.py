"""Queries on keyed histories: revisions, regimes, transitions, tails, splices."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoplane.operators import audit
from chronoplane.operators.rolling import Frames
from chronoplane.plans.inputs import DAYS_SQL, WEEKS_SQL, days, weeks
from chronoplane.plans.registry import neat, query, table

LABELS = ["click", "error", "purchase", "signup", "view"]


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))


_RUNS = """e AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS c FROM events),
    m AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM e),
    runs AS (SELECT user_id, CAST(run AS BIGINT) AS run, any_value(event_type) AS event_type, min(ts) AS start, max(ts) AS finish, count(*) AS steps FROM m GROUP BY user_id, run)"""
_PAIRS = "p AS (SELECT *, lag(event_type) OVER w AS from_label, event_type AS to_label, lag(value) OVER w AS pre FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"


@query("latest_per_key", "SELECT user_id, CAST(ts AS DATE) AS day, arg_max(value, (ts, event_id)) AS value, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1, 2")
def latest_per_key(spark, sf_dir):
    return audit.latest_per_key(_events(spark, sf_dir), ["user_id", "day"], ["ts", "event_id"], ["value", "event_type"])


@query("regime_runs", f"WITH {_RUNS} SELECT * FROM runs")
def regime_runs(spark, sf_dir):
    return audit.runs(_events(spark, sf_dir), "user_id", ["ts", "event_id"], "event_type")


@query("regime_durations", f"WITH {_RUNS} SELECT event_type, count(*) AS n_runs, min(steps) AS shortest, median(steps) AS median, round(avg(steps), 6) + 0.0 AS mean, max(steps) AS longest FROM runs GROUP BY 1")
def regime_durations(spark, sf_dir):
    out = audit.durations(audit.runs(_events(spark, sf_dir), "user_id", ["ts", "event_id"], "event_type"), "event_type")
    return out.withColumn("mean", neat("mean"))


@query("transition_matrix", f"WITH {_PAIRS} SELECT from_label, " + ", ".join(f"count(*) FILTER (to_label = '{x}') AS {x}" for x in LABELS) + " FROM p WHERE from_label IS NOT NULL GROUP BY 1")
def transition_matrix(spark, sf_dir):
    return audit.transition_matrix(_events(spark, sf_dir), "user_id", ["ts", "event_id"], "event_type", LABELS)


@query("event_response", f"WITH {_PAIRS} SELECT from_label, to_label, count(*) AS n_events, round(avg(pre), 6) + 0.0 AS pre, round(avg(value), 6) + 0.0 AS post, round(avg(value - pre), 6) + 0.0 AS delta FROM p WHERE from_label <> to_label GROUP BY 1, 2")
def event_response(spark, sf_dir):
    out = audit.event_response(_events(spark, sf_dir), "user_id", ["ts", "event_id"], "event_type", "value")
    return out.withColumns({c: neat(c) for c in ("pre", "post", "delta")})


@query("compressed_sequence", f"WITH {_RUNS} SELECT user_id, string_agg(event_type, ' -> ' ORDER BY run) AS sequence FROM runs GROUP BY 1")
def compressed_sequence(spark, sf_dir):
    return audit.compressed_sequence(audit.runs(_events(spark, sf_dir), "user_id", ["ts", "event_id"], "event_type"), "user_id", "event_type")


@query(
    "strict_epoch",
    """WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, max(value) >= 20 AS ok FROM events GROUP BY 1, 2),
    s AS (SELECT *, bool_and(ok) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS all_ok FROM d)
    SELECT user_id, min(day) AS epoch, count(*) AS n_days FROM s WHERE all_ok GROUP BY 1""",
)
def strict_epoch(spark, sf_dir):
    daily = _events(spark, sf_dir).groupBy("user_id", "day").agg((F.max("value") >= 20).alias("ok"))
    return audit.strict_epoch(daily, "user_id", "day", "ok")


@query(
    "top_bottom_k",
    f"WITH {DAYS_SQL} (SELECT series_id, day, spread, 'top' AS side FROM days ORDER BY spread DESC, series_id, day LIMIT 20) UNION ALL (SELECT series_id, day, spread, 'bottom' FROM days ORDER BY spread, series_id, day LIMIT 20)",
)
def top_bottom_k(spark, sf_dir):
    return audit.extremes(days(spark, sf_dir).select("series_id", "day", "spread"), ["series_id", "day"], "spread", 20)


@query("warmup_boundary", f"WITH {DAYS_SQL}, k AS (SELECT series_id, day, row_number() OVER (PARTITION BY series_id ORDER BY day) AS i FROM days WHERE n_orders > 1) SELECT series_id, day AS boundary FROM k WHERE i = 20")
def warmup_boundary(spark, sf_dir):
    base = days(spark, sf_dir).withColumn("v", F.when(F.col("n_orders") > 1, F.col("spread")))
    return audit.nth_known(base, "series_id", "day", "v", 20)


@query("distribution", "SELECT event_type, count(value) AS n, " + ", ".join(f"round(quantile_cont(value, {s}), 6) + 0.0 AS p{int(100 * s + 0.5):02d}" for s in (0.01, 0.05, 0.5, 0.95, 0.99)) + " FROM events GROUP BY 1")
def distribution(spark, sf_dir):
    out = audit.distribution(_events(spark, sf_dir), "event_type", "value")
    return out.withColumns({c: neat(c) for c in ("p01", "p05", "p50", "p95", "p99")})


@query(
    "source_sensitivity",
    f"""WITH {WEEKS_SQL}, a AS (SELECT * FROM weeks), b AS (SELECT series_id, week_end + 14 AS week_end, price * 1.01 AS price FROM weeks)
    SELECT series_id, count(*) AS n_weeks, count(*) FILTER (a.price IS NULL) AS only_b, count(*) FILTER (b.price IS NULL) AS only_a, round(avg(abs(a.price - b.price)), 4) + 0.0 AS mean_abs_diff FROM a FULL OUTER JOIN b USING (series_id, week_end) GROUP BY 1""",
)
def source_sensitivity(spark, sf_dir):
    base = weeks(spark, sf_dir)
    b = base.withColumn("week_end", F.date_add("week_end", 14)).withColumn("price", F.col("price") * 1.01)
    both = audit.sensitivity(base, b, ["series_id", "week_end"], "price")
    return both.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n_weeks"), F.count_if(F.col("price_a").isNull()).alias("only_b"), F.count_if(F.col("price_b").isNull()).alias("only_a"), neat(F.avg(F.abs(F.col("price_a") - F.col("price_b"))), 4).alias("mean_abs_diff")
    )


@query(
    "splice_anti_union",
    f"""WITH {WEEKS_SQL}, a AS (SELECT series_id, week_end, spread, 'primary' AS origin FROM weeks), b AS (SELECT series_id, week_end + 21 AS week_end, spread, 'supplement' AS origin FROM weeks)
    SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.series_id = b.series_id AND a.week_end = b.week_end)""",
)
def splice_anti_union(spark, sf_dir):
    base = weeks(spark, sf_dir).select("series_id", "week_end", "spread")
    later = base.withColumn("week_end", F.date_add("week_end", 21)).withColumn("origin", F.lit("supplement"))
    return audit.spliced(base.withColumn("origin", F.lit("primary")), later, ["series_id", "week_end"])


@query(
    "set_operations",
    """WITH m AS (SELECT CAST(ts AS DATE) AS day, list(DISTINCT user_id) AS users FROM events GROUP BY 1), p AS (SELECT *, lag(users) OVER (ORDER BY day) AS prev FROM m)
    SELECT day, CAST(len(users) AS BIGINT) AS n, CASE WHEN prev IS NOT NULL THEN CAST(len(list_filter(users, lambda u: NOT list_contains(prev, u))) AS BIGINT) END AS joined, CAST(len(list_filter(prev, lambda u: NOT list_contains(users, u))) AS BIGINT) AS gone,
    CASE WHEN prev IS NOT NULL THEN CAST(len(list_intersect(users, prev)) AS BIGINT) END AS stayed FROM p""",
)
def set_operations(spark, sf_dir):
    # Membership changes day on day by keys, so no day's member set is ever gathered.
    seen = _events(spark, sf_dir).select("user_id", "day").distinct()
    calendar = seen.select("day").distinct()
    order = Frames("one", "day")
    calendar = calendar.withColumn("one", F.lit(1)).withColumn("next", F.lead("day").over(order.order)).drop("one")
    then = seen.join(calendar, "day").where("next IS NOT NULL").select("user_id", F.col("next").alias("day"), F.lit(1).alias("before"))
    both = seen.withColumn("now", F.lit(1)).join(then, ["user_id", "day"], "full_outer")
    counts = both.groupBy("day").agg(F.count("now").alias("n"), F.count_if(F.col("before").isNull()).alias("joined"), F.count_if(F.col("now").isNull()).alias("gone"), F.count(F.col("now") + F.col("before")).alias("stayed"), F.count("before").alias("b"))
    return counts.select("day", "n", *[F.when(F.col("b") > 0, F.col(c)).alias(c) for c in ("joined", "gone", "stayed")])


@query(
    "behavior_windows",
    f"""WITH {WEEKS_SQL}, q AS (SELECT quantile_cont(spread, 0.8) AS cut FROM weeks), w(name, lo, hi) AS (VALUES ('early', DATE '1995-06-01', DATE '1996-06-30'), ('middle', DATE '1997-01-01', DATE '1998-12-31'), ('late', DATE '2000-01-01', DATE '2001-12-31'))
    SELECT name, series_id, count(*) AS n_weeks, count(*) FILTER (spread >= cut) AS n_tail, min(week_end) FILTER (spread >= cut) AS first_tail, CAST(round((min(week_end) FILTER (spread >= cut) - any_value(lo)) / 7.0) AS BIGINT) AS lag_weeks
    FROM weeks, q JOIN w ON week_end BETWEEN lo AND hi GROUP BY 1, 2""",
)
def behavior_windows(spark, sf_dir):
    base = weeks(spark, sf_dir)
    spans = spark.createDataFrame([("early", "1995-06-01", "1996-06-30"), ("middle", "1997-01-01", "1998-12-31"), ("late", "2000-01-01", "2001-12-31")], "name string, lo string, hi string")
    spans = spans.select("name", F.to_date("lo").alias("lo"), F.to_date("hi").alias("hi"))
    cut = base.agg(F.percentile("spread", 0.8).alias("cut"))
    hit = base.crossJoin(F.broadcast(cut)).join(F.broadcast(spans), F.col("week_end").between(F.col("lo"), F.col("hi")))
    tail = F.col("spread") >= F.col("cut")
    first = F.min(F.when(tail, F.col("week_end")))
    return hit.groupBy("name", "series_id").agg(F.count(F.lit(1)).alias("n_weeks"), F.count_if(tail).alias("n_tail"), first.alias("first_tail"), F.round(F.datediff(first, F.min("lo")) / 7.0).cast("long").alias("lag_weeks"))


@query("null_diagnosis", "SELECT 'text' AS column_name, count(text) AS n_known, count(*) - count(text) AS n_null FROM documents UNION ALL SELECT 'lang', count(lang), count(*) - count(lang) FROM documents UNION ALL SELECT 'source', count(source), count(*) - count(source) FROM documents")
def null_diagnosis(spark, sf_dir):
    return audit.missing_columns(table(spark, sf_dir, "documents"), ["text", "lang", "source"])
