"""Queries on series: weeks, as-of reads, vintages, rolling statistics, recursions."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoplane.functions import recursions as rec
from chronoplane.operators import pit, timeaxis
from chronoplane.operators.folds import run_fold
from chronoplane.operators.rolling import Frames, exo_pretransform, logistic, weighted_median
from chronoplane.plans.inputs import DAYS_SQL, FRIDAY, VINTAGES_SQL, WEEKS_SQL, days, vintages, weeks
from chronoplane.plans.registry import neat, query, table

_EVENT_DAYS = "events_d AS (SELECT user_id, CAST(ts AS DATE) AS day, ts, event_id, value FROM events)"


@query("weekly_decision_index", f"SELECT event_type, {FRIDAY.format('CAST(ts AS DATE)')} AS week_end, max(ts) AS decision_ts FROM events GROUP BY 1, 2")
def weekly_decision_index(spark, sf_dir):
    return timeaxis.decision_index(table(spark, sf_dir, "events"), "event_type", "ts")


@query(
    "weekly_last_ffill",
    f"""WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2),
    w AS (SELECT user_id, {FRIDAY.format('day')} AS week_end, arg_max(value, day) AS value FROM e GROUP BY 1, 2),
    g AS (SELECT user_id, CAST(unnest(generate_series(min(week_end), max(week_end), INTERVAL 7 DAY)) AS DATE) AS week_end FROM w GROUP BY 1)
    SELECT user_id, week_end, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY week_end) AS value FROM g LEFT JOIN w USING (user_id, week_end)""",
)
def weekly_last_ffill(spark, sf_dir):
    daily = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    return timeaxis.weekly_last(daily, "user_id", "day", ["value"])


@query(
    "weekly_median",
    f"""WITH {DAYS_SQL}, w AS (SELECT series_id, {FRIDAY.format('day')} AS week_end, median(price) AS price, median(spread) AS spread FROM days GROUP BY 1, 2),
    g AS (SELECT series_id, CAST(unnest(generate_series(min(week_end), max(week_end), INTERVAL 7 DAY)) AS DATE) AS week_end FROM w GROUP BY 1)
    SELECT series_id, week_end, round(price, 6) + 0.0 AS price, round(spread, 6) + 0.0 AS spread FROM g LEFT JOIN w USING (series_id, week_end)""",
)
def weekly_median(spark, sf_dir):
    out = timeaxis.weekly_median(days(spark, sf_dir), "series_id", "day", ["price", "spread"])
    return out.select("series_id", "week_end", neat("price").alias("price"), neat("spread").alias("spread"))


@query(
    "calendar_checks",
    f"""WITH {DAYS_SQL} SELECT series_id, count(*) AS n_rows, count(*) FILTER (day IS NULL) AS n_null, count(day) - count(DISTINCT day) AS n_repeated FROM days GROUP BY 1""",
)
def calendar_checks(spark, sf_dir):
    return timeaxis.checked_index(days(spark, sf_dir), "series_id", "day")


@query(
    "sla_cutoff",
    f"""WITH {WEEKS_SQL} SELECT DISTINCT week_end, timezone('UTC', timezone('America/New_York', CAST(week_end + 1 AS TIMESTAMP) + INTERVAL 12 HOUR)) AS cutoff_utc FROM weeks""",
)
def sla_cutoff(spark, sf_dir):
    return weeks(spark, sf_dir).select("week_end").distinct().select("week_end", timeaxis.sla_cutoff(F.col("week_end")).cast("timestamp_ntz").alias("cutoff_utc"))


_DECISIONS = "d AS (SELECT DISTINCT user_id, date_trunc('hour', ts) + INTERVAL 1 HOUR AS ts FROM events), o AS (SELECT user_id, ts, max(value) AS value FROM events GROUP BY 1, 2)"


def _decisions(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    asked = events.select("user_id", (F.date_trunc("hour", "ts") + F.expr("interval 1 hour")).cast(events.schema["ts"].dataType).alias("ts")).distinct()
    return asked, events.groupBy("user_id", "ts").agg(F.max("value").alias("value"))


@query("asof_backward", f"WITH {_DECISIONS} SELECT d.user_id, d.ts, o.ts AS matched_ts, o.value FROM d ASOF LEFT JOIN o ON d.user_id = o.user_id AND d.ts >= o.ts")
def asof_backward(spark, sf_dir):
    asked, known = _decisions(spark, sf_dir)
    return pit.asof_backward(asked, known, "user_id", "ts", ["value"])


@query(
    "asof_tolerance",
    f"""WITH {_DECISIONS}, t AS (SELECT user_id, ts + INTERVAL 10 HOUR AS ts FROM d)
    SELECT t.user_id, t.ts, CASE WHEN o.ts >= t.ts - INTERVAL 12 HOUR THEN o.ts END AS matched_ts, CASE WHEN o.ts >= t.ts - INTERVAL 12 HOUR THEN o.value END AS value
    FROM t ASOF LEFT JOIN o ON t.user_id = o.user_id AND t.ts >= o.ts""",
)
def asof_tolerance(spark, sf_dir):
    asked, known = _decisions(spark, sf_dir)
    kind = asked.schema["ts"].dataType
    later = asked.withColumn("ts", (F.col("ts") + F.expr("interval 10 hours")).cast(kind))
    return pit.asof_backward(later, known, "user_id", "ts", ["value"], "12 hours")


@query(
    "asof_nearest",
    f"""WITH {_EVENT_DAYS}, o AS (SELECT user_id, CAST(day + CASE WHEN value > 50 THEN 0 ELSE 3 END AS DATE) AS day, max(value) AS value FROM events_d GROUP BY 1, 2), d AS (SELECT DISTINCT user_id, day FROM events_d),
    b AS (SELECT d.*, o.day AS bd, o.value AS bv FROM d ASOF LEFT JOIN o ON d.user_id = o.user_id AND d.day >= o.day),
    f AS (SELECT d.*, o.day AS fd, o.value AS fv FROM d ASOF LEFT JOIN o ON d.user_id = o.user_id AND d.day <= o.day),
    m AS (SELECT user_id, day, CASE WHEN bd IS NOT NULL AND (fd IS NULL OR day - bd <= fd - day) THEN bd ELSE fd END AS md, CASE WHEN bd IS NOT NULL AND (fd IS NULL OR day - bd <= fd - day) THEN bv ELSE fv END AS v FROM b JOIN f USING (user_id, day))
    SELECT user_id, day, CASE WHEN abs(day - md) <= 5 THEN md END AS matched_day, CASE WHEN abs(day - md) <= 5 THEN v END AS value FROM m""",
)
def asof_nearest(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    # Small values are known three days late.
    known = events.withColumn("day", F.date_add("day", F.when(F.col("value") > 50, 0).otherwise(3))).groupBy("user_id", "day").agg(F.max("value").alias("value"))
    return pit.asof_nearest(events.select("user_id", "day").distinct(), known, "user_id", "day", ["value"], 5)


@query(
    "asof_forward_strict",
    f"WITH {WEEKS_SQL}, {DAYS_SQL} SELECT w.series_id, w.week_end AS day, d.day AS matched_day, round(d.price, 6) + 0.0 AS price FROM weeks w ASOF LEFT JOIN days d ON w.series_id = d.series_id AND w.week_end < d.day",
)
def asof_forward_strict(spark, sf_dir):
    asked = weeks(spark, sf_dir).select("series_id", F.col("week_end").alias("day"))
    out = pit.asof_forward(asked, days(spark, sf_dir), "series_id", "day", ["price"])
    return out.select("series_id", "day", "matched_day", neat("price").alias("price"))


_HORIZON = 400


@query(
    "bitemporal_latest_visible",
    f"WITH {VINTAGES_SQL} SELECT ticker, day, arg_max(value, (known_at, value)) AS value, max(known_at) AS known_at FROM vintages WHERE known_at <= day + {_HORIZON} GROUP BY 1, 2",
)
def bitemporal_latest_visible(spark, sf_dir):
    return pit.latest_visible(vintages(spark, sf_dir), ["ticker", "day"], "known_at", "value", F.date_add("day", _HORIZON))


@query(
    "bitemporal_latest_then_checked",
    f"WITH {VINTAGES_SQL}, l AS (SELECT ticker, day, arg_max(value, (known_at, value)) AS value, max(known_at) AS known_at FROM vintages GROUP BY 1, 2) SELECT * FROM l WHERE known_at <= day + {_HORIZON}",
)
def bitemporal_latest_then_checked(spark, sf_dir):
    return pit.latest_then_checked(vintages(spark, sf_dir), ["ticker", "day"], "known_at", "value", F.date_add("day", _HORIZON))


@query(
    "bitemporal_snapshot",
    f"WITH {VINTAGES_SQL} SELECT day, count(DISTINCT ticker) AS n_members, array_to_string(list_sort(list(DISTINCT ticker)), ',') AS members FROM vintages WHERE known_at <= day + {_HORIZON} GROUP BY 1",
)
def bitemporal_snapshot(spark, sf_dir):
    out = pit.snapshot_members(vintages(spark, sf_dir), "day", "ticker", "known_at", F.date_add("day", _HORIZON))
    return out.withColumn("members", F.array_join("members", ","))


_MONTHLY = f"""{VINTAGES_SQL}, prices AS (SELECT ticker, CAST(date_trunc('month', day) AS DATE) AS day, max(value) AS price FROM vintages GROUP BY 1, 2),
    actions AS (SELECT ticker, CAST(date_trunc('month', known_at) AS DATE) AS day, 1.0 - CAST(max(l_discount) AS DOUBLE) AS factor FROM vintages GROUP BY 1, 2)"""


def _monthly(spark, sf_dir):
    facts = vintages(spark, sf_dir)
    prices = facts.groupBy("ticker", F.trunc("day", "month").alias("day")).agg(F.max("value").alias("price"))
    actions = facts.groupBy("ticker", F.trunc("known_at", "month").alias("day")).agg((1.0 - F.max("l_discount")).alias("factor"))
    return prices, actions


@query(
    "adjustment_factor",
    f"""WITH {_MONTHLY}, p AS (SELECT ticker, day, price, max(day) OVER (PARTITION BY ticker) AS basis FROM prices)
    SELECT p.ticker, p.day, p.basis, p.price, round(coalesce(product(a.factor), 1.0), 9) + 0.0 AS factor FROM p LEFT JOIN actions a ON a.ticker = p.ticker AND a.day > p.day AND a.day <= p.basis GROUP BY ALL""",
)
def adjustment_factor(spark, sf_dir):
    prices, actions = _monthly(spark, sf_dir)
    basis = prices.groupBy("ticker").agg(F.max("day").alias("basis"))
    out = pit.adjustment_factor(prices.join(basis, "ticker"), actions, "ticker", "day", "factor", "basis")
    return out.select("ticker", "day", "basis", "price", neat("factor", 9).alias("factor"))


@query(
    "adjusted_window",
    f"""WITH {_MONTHLY}, p AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY day) AS i FROM prices),
    w AS (SELECT e.ticker, e.day, s.i, any_value(s.price) * coalesce(product(a.factor), 1.0) AS v FROM p e JOIN p s ON s.ticker = e.ticker AND s.i BETWEEN e.i - 5 AND e.i AND e.i >= 6
      LEFT JOIN actions a ON a.ticker = e.ticker AND a.day > s.day AND a.day <= e.day GROUP BY ALL)
    SELECT ticker, day, round(avg(v) / arg_max(v, i), 6) + 0.0 AS mean_ratio, round(arg_min(v, i) / arg_max(v, i), 6) + 0.0 AS first_ratio FROM w GROUP BY 1, 2""",
)
def adjusted_window(spark, sf_dir):
    prices, actions = _monthly(spark, sf_dir)
    out = pit.adjusted_window(prices, actions, "ticker", "day", "price", "factor", 6)
    mean = F.aggregate("window", F.lit(0.0), lambda acc, x: acc + x) / F.size("window")
    first, last = F.get("window", F.lit(0)), F.get("window", F.lit(5))
    return out.select("ticker", "day", neat(mean / last).alias("mean_ratio"), neat(first / last).alias("first_ratio"))


_W = "OVER (PARTITION BY series_id ORDER BY day ROWS BETWEEN {0} PRECEDING AND {1})"
_last = lambda n: _W.format(n - 1, "CURRENT ROW")
_prior = lambda n: _W.format(n, "1 PRECEDING")


@query(
    "rob_z",
    f"""WITH {DAYS_SQL} SELECT series_id, day, CASE WHEN count(spread) {_prior(104)} = 104 THEN round((spread - quantile_cont(spread, 0.5) {_prior(104)}) / (1.4826 * mad(spread) {_prior(104)} + 1e-12), 6) + 0.0 END AS z FROM days""",
)
def rob_z(spark, sf_dir):
    f = Frames("series_id", "day")
    return days(spark, sf_dir).select("series_id", "day", neat(f.robust_z(F.col("spread"), 104)).alias("z"))


@query(
    "rolling_moments",
    f"""WITH {DAYS_SQL}, s AS (SELECT *, ln(price / lag(price) OVER (PARTITION BY series_id ORDER BY day)) AS step FROM days)
    SELECT series_id, day, CASE WHEN count(price) {_last(52)} = 52 THEN round(price / avg(price) {_last(52)} - 1, 6) + 0.0 END AS off_mean,
    CASE WHEN count(step) {_last(20)} = 20 THEN round(stddev_samp(step) {_last(20)} * sqrt(52.0), 6) + 0.0 END AS realized_vol,
    round(price - lag(price, 4) OVER (PARTITION BY series_id ORDER BY day), 6) + 0.0 AS delta4, round(ln(1 + greatest(spread, 0.0)), 6) + 0.0 AS log_spread FROM s""",
)
def rolling_moments(spark, sf_dir):
    f, price = Frames("series_id", "day"), F.col("price")
    return days(spark, sf_dir).withColumn("vol", f.realized_vol(price)).select(
        "series_id", "day", neat(f.deviation(price, 52)).alias("off_mean"), neat("vol").alias("realized_vol"), neat(f.delta(price, 4)).alias("delta4"), neat(exo_pretransform(F.col("spread"))).alias("log_spread")
    )


@query(
    "rolling_quantiles",
    f"""WITH {DAYS_SQL}, s AS (SELECT *, price - lag(price) OVER (PARTITION BY series_id ORDER BY day) AS step FROM days)
    SELECT series_id, day, round(greatest(quantile_cont(step * step, 0.1) {_last(260)}, 1e-12), 4) + 0.0 AS noise, round(1.4826 * mad(spread) {_last(260)}, 4) + 0.0 AS scale FROM s""",
)
def rolling_quantiles(spark, sf_dir):
    f = Frames("series_id", "day")
    step = days(spark, sf_dir).withColumn("step", f.delta(F.col("price"), 1)).withColumn("square", F.col("step") * F.col("step"))
    return step.select("series_id", "day", neat(F.greatest(f.quantile(F.col("square"), 260, 0.1), F.lit(1e-12)), 4).alias("noise"), neat(f.mad_scale(F.col("spread"), 260), 4).alias("scale"))


@query(
    "percentile_rank",
    f"""WITH {WEEKS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY week_end) AS i FROM weeks)
    SELECT a.series_id, a.week_end, round(CAST(count(*) FILTER (b.price <= a.price) AS DOUBLE) / count(b.price), 6) + 0.0 AS share FROM n a JOIN n b ON a.series_id = b.series_id AND b.i BETWEEN a.i - 259 AND a.i GROUP BY 1, 2""",
)
def percentile_rank(spark, sf_dir):
    f = Frames("series_id", "week_end")
    ranked = weeks(spark, sf_dir).withColumn("held", F.collect_list("price").over(f.last(260)))
    return ranked.select("series_id", "week_end", neat(F.size(F.filter("held", lambda v: v <= F.col("price"))) / F.size("held")).alias("share"))


def _steps(base: str, value: str) -> str:
    return f"s AS (SELECT series_id, {base} AS t, {value} AS x, row_number() OVER (PARTITION BY series_id ORDER BY {base}) AS i FROM {'days' if base == 'day' else 'weeks'})"


def _recursive(source: str, value: str, zero: str, step: str, columns: str) -> str:
    """SQL of a fold over (series_id, i): ``f`` is the state before, ``s`` the new row."""
    return f"WITH RECURSIVE {source}, {_steps('day', value)}, f AS (SELECT series_id, t, i, {zero} FROM s WHERE i = 1 UNION ALL SELECT s.series_id, s.t, s.i, {step} FROM f JOIN s ON s.series_id = f.series_id AND s.i = f.i + 1) SELECT series_id, t AS day, {columns} FROM f"


_R = "2 ** (-1.0 / 26)"


@query("ew_mean", _recursive(DAYS_SQL, "price", "x AS m", f"{_R} * f.m + (1 - {_R}) * s.x", "round(m, 4) + 0.0 AS mean"))
def ew_mean(spark, sf_dir):
    out = run_fold(days(spark, sf_dir), "series_id", "day", lambda: rec.EwMean(26), ["price"], "mean double")
    return out.withColumn("mean", neat("mean", 4))


def _ew_z(gap: str) -> str:
    return _recursive(
        DAYS_SQL, "spread", "x AS m, 0.0::DOUBLE AS v, NULL::DOUBLE AS z",
        f"{_R} * f.m + (1 - {_R}) * s.x, {_R} * f.v + (1 - {_R}) * ({gap}) ** 2, (s.x - ({_R} * f.m + (1 - {_R}) * s.x)) / sqrt({_R} * f.v + (1 - {_R}) * ({gap}) ** 2 + 1e-12)",
        "CASE WHEN i > 6 THEN round(z, 6) + 0.0 END AS z",
    )


@query("ew_z", _ew_z("s.x - f.m"))
def ew_z(spark, sf_dir):
    return run_fold(days(spark, sf_dir), "series_id", "day", lambda: rec.EwZ(26), ["spread"], "z double").withColumn("z", neat("z"))


@query("ew_z_huber", _ew_z("least(greatest(s.x - f.m, -2.0 * sqrt(f.v + 1e-12)), 2.0 * sqrt(f.v + 1e-12))"))
def ew_z_huber(spark, sf_dir):
    return run_fold(days(spark, sf_dir), "series_id", "day", lambda: rec.EwZ(26, clip=2.0), ["spread"], "z double").withColumn("z", neat("z"))


@query(
    "ew_correlation",
    f"""WITH RECURSIVE {DAYS_SQL}, s AS (SELECT series_id, day AS t, price AS x, spread AS y, row_number() OVER (PARTITION BY series_id ORDER BY day) AS i FROM days),
    f AS (SELECT series_id, t, i, x AS mx, y AS my, 0.0::DOUBLE AS xy, 0.0::DOUBLE AS xx, 0.0::DOUBLE AS yy FROM s WHERE i = 1
      UNION ALL SELECT s.series_id, s.t, s.i, r * mx + (1 - r) * x, r * my + (1 - r) * y, r * xy + (1 - r) * (x - mx) * (y - my), r * xx + (1 - r) * (x - mx) ** 2, r * yy + (1 - r) * (y - my) ** 2
      FROM f JOIN s ON s.series_id = f.series_id AND s.i = f.i + 1, (SELECT 2 ** (-1.0 / 78) AS r))
    SELECT series_id, t AS day, CASE WHEN i > 1 THEN round(least(1.0, greatest(-1.0, xy / (sqrt(xx * yy) + 1e-12))), 6) + 0.0 END AS corr FROM f""",
)
def ew_correlation(spark, sf_dir):
    return run_fold(days(spark, sf_dir), "series_id", "day", lambda: rec.EwCorrelation(78), ["price", "spread"], "corr double").withColumn("corr", neat("corr"))


_LEAD_H = "CASE WHEN n_orders % 7 = 3 THEN NULL ELSE open_share END"


@query(
    "lead_envelope",
    f"""WITH RECURSIVE {DAYS_SQL}, {_steps('day', _LEAD_H)}, one AS (SELECT series_id, t, i - 1 AS i, x FROM s),
    f AS (SELECT DISTINCT series_id, DATE '1900-01-01' AS t, CAST(-1 AS BIGINT) AS i, 0.5::DOUBLE AS h, 0 AS c, '' AS status FROM s
      UNION ALL SELECT o.series_id, o.t, o.i,
        CASE WHEN o.x < 0.25 AND f.c + 1 >= 3 THEN 0.5 ELSE 0.5 + greatest(coalesce(o.x - 0.5, 0.0), 0.9 * greatest(f.h - 0.5, 0.0), 0.0) END,
        CASE WHEN o.x < 0.25 AND f.c + 1 < 3 THEN f.c + 1 ELSE 0 END,
        CASE WHEN o.x IS NULL THEN 'missing' WHEN o.x < 0.25 THEN CASE WHEN f.c + 1 >= 3 THEN 'reset' ELSE 'healing' END ELSE 'inactive' END
      FROM f JOIN one o ON o.series_id = f.series_id AND o.i = f.i + 1)
    SELECT series_id, t AS day, round(h, 6) + 0.0 AS lead, CAST(c AS INTEGER) AS calm, status FROM f WHERE i >= 0""",
)
def lead_envelope(spark, sf_dir):
    base = days(spark, sf_dir).withColumn("h", F.expr(_LEAD_H))
    return run_fold(base, "series_id", "day", rec.LeadEnvelope, ["h"], "lead double, calm int, status string").withColumn("lead", neat("lead"))


_SIGNALS = [
    "price / 600000 AS rho",
    "CAST(CASE WHEN n_orders % 5 = 4 THEN NULL ELSE n_orders % 3 END AS INTEGER) AS k",
    "CAST(CASE WHEN spread > 200000 THEN 1 ELSE 0 END AS INTEGER) AS flag",
]


@query(
    "weekly_weights",
    f"""WITH RECURSIVE {WEEKS_SQL}, s AS (SELECT series_id, week_end AS t, {', '.join(_SIGNALS)}, row_number() OVER (PARTITION BY series_id ORDER BY week_end) AS i FROM weeks),
    f AS (SELECT DISTINCT series_id, DATE '1900-01-01' AS t, CAST(0 AS BIGINT) AS i, NULL::DOUBLE AS target, NULL::DOUBLE AS held, false AS active, 0 AS outside FROM s
      UNION ALL SELECT series_id, t, i, target, CASE WHEN act OR held IS NULL OR abs(target - held) >= 0.05 THEN target ELSE held END, act, out FROM (
        SELECT *, CASE WHEN act THEN 0.0 ELSE 1.0 - least(1.0, greatest(0.0, rho)) END AS target FROM (
          SELECT s.series_id, s.t, s.i, s.rho, f.held,
            CASE WHEN f.active THEN NOT (CASE WHEN s.k IS NOT NULL AND s.k <> 0 THEN f.outside + 1 ELSE 0 END >= 2) ELSE coalesce(s.k = 0 AND s.flag = 1, false) END AS act,
            CASE WHEN f.active THEN CASE WHEN s.k IS NOT NULL AND s.k <> 0 THEN f.outside + 1 ELSE 0 END WHEN coalesce(s.k = 0 AND s.flag = 1, false) THEN 0 ELSE f.outside END AS out
          FROM f JOIN s ON s.series_id = f.series_id AND s.i = f.i + 1)))
    SELECT series_id, t AS week_end, round(target, 6) + 0.0 AS target, round(held, 6) + 0.0 AS held, active, CAST(outside AS INTEGER) AS outside FROM f WHERE i > 0""",
)
def weekly_weights(spark, sf_dir):
    base = weeks(spark, sf_dir).selectExpr("series_id", "week_end", *_SIGNALS)
    out = run_fold(base, "series_id", "week_end", rec.WeeklyWeights, ["rho", "k", "flag"], "target double, held double, active boolean, outside int")
    return out.withColumn("target", neat("target")).withColumn("held", neat("held"))


@query(
    "weighted_robust_z",
    f"""WITH {WEEKS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY week_end) AS i FROM weeks),
    p AS (SELECT a.series_id, a.i, a.week_end, a.price AS cur, b.price AS v, CAST(b.n_orders AS DOUBLE) AS w, b.i AS j FROM n a JOIN n b ON a.series_id = b.series_id AND b.i BETWEEN a.i - 26 AND a.i - 1),
    c AS (SELECT *, sum(w) OVER (PARTITION BY series_id, i ORDER BY v, w, j ROWS UNBOUNDED PRECEDING) AS upto, sum(w) OVER (PARTITION BY series_id, i) AS total FROM p),
    m AS (SELECT series_id, i, week_end, any_value(cur) AS cur, min(v) FILTER (upto >= 0.5 * total) AS med FROM c GROUP BY 1, 2, 3),
    d AS (SELECT p.series_id, p.i, abs(p.v - m.med) AS v, p.w, p.j FROM p JOIN m USING (series_id, i)),
    e AS (SELECT *, sum(w) OVER (PARTITION BY series_id, i ORDER BY v, w, j ROWS UNBOUNDED PRECEDING) AS upto, sum(w) OVER (PARTITION BY series_id, i) AS total FROM d),
    k AS (SELECT series_id, i, min(v) FILTER (upto >= 0.5 * total) AS mad FROM e GROUP BY 1, 2)
    SELECT series_id, week_end, round(greatest(-1e6, least(1e6, (cur - med) / (1.4826 * mad + 1e-12))), 6) + 0.0 AS z FROM m JOIN k USING (series_id, i)""",
)
def weighted_robust_z(spark, sf_dir):
    f = Frames("series_id", "week_end")
    held = weeks(spark, sf_dir).withColumn("held", F.collect_list(F.struct(F.col("price").alias("v"), F.col("n_orders").cast("double").alias("w"))).over(f.prior(26))).where(F.size("held") > 0)
    middle = held.withColumn("med", weighted_median(F.col("held")))
    spread = middle.withColumn("mad", weighted_median(F.transform("held", lambda p: F.struct(F.abs(p["v"] - F.col("med")).alias("v"), p["w"].alias("w")))))
    # No deviation leaves EPS alone below the line: cut for the comparison.
    score = (F.col("price") - F.col("med")) / (1.4826 * F.col("mad") + 1e-12)
    return spread.select("series_id", "week_end", neat(F.greatest(F.lit(-1e6), F.least(F.lit(1e6), score))).alias("z"))


@query("micro_score", f"WITH {WEEKS_SQL} SELECT series_id, week_end, round(1 / (1 + exp(-(0.5 * (price - 250000) / 50000 + 0.5 * (open_share - 0.5)))), 6) + 0.0 AS h FROM weeks")
def micro_score(spark, sf_dir):
    raw = 0.5 * (F.col("price") - 250000) / 50000 + 0.5 * (F.col("open_share") - 0.5)
    return weeks(spark, sf_dir).select("series_id", "week_end", neat(logistic(raw)).alias("h"))
