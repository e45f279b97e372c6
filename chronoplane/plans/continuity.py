"""Queries on continuity: per-column as-of reads, source precedence, splices, replays, regimes, warm-up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoplane.operators import eigen, pit, regimes, routing, scenarios, splices, state, warmup
from chronoplane.operators.rolling import Frames
from chronoplane.plans.cycles import SNAPS_SQL, snapshots
from chronoplane.plans.inputs import DAYS_SQL, WEEKS_SQL, days, weeks
from chronoplane.plans.registry import neat, query, table
from chronoplane.plans.reports import COV_SQL, DRIFT_SQL, SHORT, STATES_SQL, chain_inputs, covariance_rows

_LIMITS = {"price": None, "spread": "10 days", "open_share": "3 days"}


@query(
    "asof_frame",
    f"""WITH {DAYS_SQL}, {WEEKS_SQL}, o AS (SELECT series_id, day, CASE WHEN n_orders > 1 THEN price END AS price, nullif(spread, 0) AS spread, nullif(open_share, 0) AS open_share FROM days),
    d AS (SELECT series_id, week_end AS day, n_orders FROM weeks),
    p AS (SELECT d.*, o.price, o.day AS price_at FROM d ASOF LEFT JOIN (SELECT * FROM o WHERE price IS NOT NULL) o ON d.series_id = o.series_id AND d.day >= o.day),
    s AS (SELECT p.*, o.spread, o.day AS spread_at FROM p ASOF LEFT JOIN (SELECT * FROM o WHERE spread IS NOT NULL) o ON p.series_id = o.series_id AND p.day >= o.day),
    q AS (SELECT s.*, o.open_share, o.day AS open_share_at FROM s ASOF LEFT JOIN (SELECT * FROM o WHERE open_share IS NOT NULL) o ON s.series_id = o.series_id AND s.day >= o.day)
    SELECT series_id, day, n_orders, price, price_at, CASE WHEN spread_at >= day - 10 THEN spread END AS spread, CASE WHEN spread_at >= day - 10 THEN spread_at END AS spread_at,
      CASE WHEN open_share_at >= day - 3 THEN open_share END AS open_share, CASE WHEN open_share_at >= day - 3 THEN open_share_at END AS open_share_at FROM q""",
)
def asof_frame(spark, sf_dir):
    """Weekly decisions read each column of a daily frame as of then."""
    d = days(spark, sf_dir)
    known = d.select("series_id", "day", F.when(F.col("n_orders") > 1, F.col("price")).alias("price"), F.nullif("spread", F.lit(0.0)).alias("spread"), F.nullif("open_share", F.lit(0.0)).alias("open_share"))
    asked = weeks(spark, sf_dir).select("series_id", F.col("week_end").alias("day"), "n_orders")
    return pit.asof_frame(asked, known, "series_id", "day", _LIMITS)


_RANKING = ["exchange", "vendor", "model"]
_OBS = f"""{DAYS_SQL}, obs AS (SELECT series_id, day, 'exchange' AS source, CASE WHEN open_share <= 0.5 THEN price END AS price FROM days
    UNION ALL SELECT series_id, day, 'vendor', price + CASE WHEN n_orders > 3 THEN 0.25 ELSE 0 END FROM days
    UNION ALL SELECT series_id, day + 1, 'model', price FROM days)"""


def _observations(spark, sf_dir) -> DataFrame:
    """Three sources of one price: one with gaps, one that is off on busy days, one a day late."""
    d = days(spark, sf_dir)
    parts = [
        d.select("series_id", "day", F.lit("exchange").alias("source"), F.when(F.col("open_share") <= 0.5, F.col("price")).alias("price")),
        d.select("series_id", "day", F.lit("vendor").alias("source"), (F.col("price") + F.when(F.col("n_orders") > 3, 0.25).otherwise(0.0)).alias("price")),
        d.select("series_id", F.date_add("day", 1).alias("day"), F.lit("model").alias("source"), "price"),
    ]
    return reduce(DataFrame.unionByName, parts)


_RANK = "CASE source WHEN 'exchange' THEN 1 WHEN 'vendor' THEN 2 ELSE 3 END"


@query(
    "source_precedence",
    f"""WITH {_OBS}, k AS (SELECT *, {_RANK} AS r FROM obs WHERE price IS NOT NULL), c AS (SELECT series_id, day, arg_min(price, r) AS price, arg_min(source, r) AS source, count(*) AS n_sources, min(price) AS lo, max(price) AS hi FROM k GROUP BY 1, 2)
    SELECT series_id, day, round(price, 6) + 0.0 AS price, source, n_sources, CASE WHEN n_sources > 1 THEN round(greatest(price - lo, hi - price), 4) + 0.0 END AS max_abs_diff, CASE WHEN n_sources > 1 AND greatest(price - lo, hi - price) > 0.1 THEN 'conflict' ELSE 'ok' END AS status FROM c""",
)
def source_precedence(spark, sf_dir):
    out = splices.by_precedence(_observations(spark, sf_dir), ["series_id", "day"], "source", "price", _RANKING, 0.1)
    return out.withColumn("price", neat("price")).withColumn("max_abs_diff", neat("max_abs_diff", 4))


@query(
    "source_overlaps",
    f"""WITH {_OBS}, k AS (SELECT *, {_RANK} AS r FROM obs WHERE price IS NOT NULL), b AS (SELECT series_id, day, min(r) AS best_r, arg_min(price, r) AS best FROM k GROUP BY 1, 2),
    o AS (SELECT series_id, source, CASE WHEN r > best_r THEN abs(price - best) END AS off FROM k JOIN b USING (series_id, day) WHERE r > 1)
    SELECT series_id, source, count(off) AS overlap_rows, round(max(off), 4) + 0.0 AS max_abs_diff, 0.1::DOUBLE AS tolerance, CASE WHEN max(off) > 0.1 THEN 'conflict' ELSE 'ok' END AS status FROM o GROUP BY 1, 2""",
)
def source_overlaps(spark, sf_dir):
    out = splices.overlap_checks(_observations(spark, sf_dir), "series_id", ["day"], "source", "price", _RANKING, 0.1)
    return out.withColumn("max_abs_diff", neat("max_abs_diff", 4))


_REGRESSORS = ["price", "n_orders", "open_share"]
_PAIRS = [(a, b) for i, a in enumerate(_REGRESSORS) for b in _REGRESSORS[i:]]
_SHORT_Y = f"{WEEKS_SQL}, y AS (SELECT series_id, week_end, CASE WHEN week_end >= DATE '1995-01-01' THEN spread END AS spread, price, n_orders, open_share FROM weeks)"


def _det(m: list[list[str]]) -> str:
    (a, b, c), (d, e, f), (g, h, i) = m
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


def _cramer() -> str:
    s = lambda i, j: f"s{min(i, j)}{max(i, j)}"
    base = [[s(i, j) for j in range(3)] for i in range(3)]
    one = lambda k: [[f"sy{i}" if j == k else base[i][j] for j in range(3)] for i in range(3)]
    return ", ".join(f"{_det(one(k))} / {_det(base)} AS b{k}" for k in range(3))


_FIT = f"""{_SHORT_Y}, m AS (SELECT series_id, count(*) AS n, avg(spread) AS my, var_pop(spread) AS yy, {', '.join(f'avg({x}) AS m{i}, covar_pop({x}, spread) AS sy{i}' for i, x in enumerate(_REGRESSORS))},
    {', '.join(f'covar_pop({a}, {b}) AS s{_REGRESSORS.index(a)}{_REGRESSORS.index(b)}' for a, b in _PAIRS)} FROM y WHERE spread IS NOT NULL GROUP BY 1),
    b AS (SELECT *, {_cramer()} FROM m), fit AS (SELECT *, my - b0 * m0 - b1 * m1 - b2 * m2 AS level FROM b)"""


def _short_series(spark, sf_dir) -> DataFrame:
    """Weeks whose spread is observed from 1995 on only."""
    w = weeks(spark, sf_dir).select("series_id", "week_end", "spread", *_REGRESSORS)
    return w.withColumn("spread", F.when(F.col("week_end") >= F.lit("1995-01-01").cast("date"), F.col("spread")))


@query("ols_fit", f"WITH {_FIT} SELECT series_id, n, round(b0, 6) + 0.0 AS slope_price, round(b1 / 1000, 6) + 0.0 AS slope_orders, round(b2 / 1000, 6) + 0.0 AS slope_open, round(level / 1000, 5) + 0.0 AS intercept, round((b0 * sy0 + b1 * sy1 + b2 * sy2) / yy, 6) + 0.0 AS r2 FROM fit")
def ols_fit(spark, sf_dir):
    out = splices.fit_ols(_short_series(spark, sf_dir), "series_id", "spread", _REGRESSORS)
    b = lambda i: F.get("slopes", F.lit(i))
    return out.select("series_id", "n", neat(b(0)).alias("slope_price"), neat(b(1) / 1000).alias("slope_orders"), neat(b(2) / 1000).alias("slope_open"), neat(F.col("intercept") / 1000, 5).alias("intercept"), neat("r2").alias("r2"))


@query(
    "ols_splice_rows",
    f"""WITH {_FIT}, f AS (SELECT series_id, min(week_end) FILTER (spread IS NOT NULL) AS first FROM y GROUP BY 1), r AS (SELECT series_id, week_end, CASE WHEN week_end < first THEN greatest(150000.0, least(400000.0, level + b0 * price + b1 * n_orders + b2 * open_share)) ELSE spread END AS spread,
      CASE WHEN week_end < first THEN 'predicted' ELSE 'observed' END AS origin FROM y JOIN fit USING (series_id) JOIN f USING (series_id))
    SELECT series_id, week_end, round(spread / 1000, 5) + 0.0 AS spread, origin FROM r WHERE spread IS NOT NULL""",
)
def ols_splice_rows(spark, sf_dir):
    """The spread before 1995 predicted from three longer series, within bounds."""
    out = splices.ols_splice(_short_series(spark, sf_dir), "series_id", "week_end", "spread", _REGRESSORS, 150000.0, 400000.0)
    return out.withColumn("spread", neat(F.col("spread") / 1000, 5))


_EIGEN = """CASE WHEN fine THEN greatest(e1, 1e-8) END AS eigval_1, CASE WHEN fine THEN e2 END AS eigval_2_raw, CASE WHEN fine THEN greatest(e2, 1e-4 * greatest(e1, 1e-8), 1e-8) END AS eigval_2_reg, fine AS cov_ok"""
_EIGEN_ROWS = "e AS (SELECT *, (a + c) / 2 + sqrt((a - c) ** 2 / 4 + b * b) AS e1, (a + c) / 2 - sqrt((a - c) ** 2 / 4 + b * b) AS e2 FROM {0}), g AS (SELECT *, {1} FROM (SELECT *, e1 >= -1e-8 AND e2 >= -1e-8 AS fine FROM e))"


@query(
    "eigen_diagnostics",
    f"""WITH RECURSIVE {COV_SQL}, {_EIGEN_ROWS.format('(SELECT series_id, day, a, b, c FROM f WHERE i > 0)', _EIGEN)}
    SELECT series_id, day, round(eigval_1, 6) + 0.0 AS eigval_1, round(eigval_2_raw, 6) + 0.0 AS eigval_2_raw, round(eigval_2_reg, 6) + 0.0 AS eigval_2_reg, round(eigval_1 / greatest(eigval_2_raw, 1e-15), 3) + 0.0 AS condition_number_raw, round(eigval_1 / eigval_2_reg, 3) + 0.0 AS condition_number_reg,
      eigval_2_raw < greatest(1e-4 * eigval_1, 1e-8) AS eigval_2_was_floored, cov_ok, round(eigval_1 + eigval_2_reg, 6) + 0.0 AS reg_trace, round(eigval_1 * eigval_2_reg, 6) + 0.0 AS reg_det FROM g""",
)
def eigen_diagnostics(spark, sf_dir):
    """Health of the running covariance of each step, and of its floored form."""
    out = eigen.regularised(eigen.eigen_diagnostics(covariance_rows(spark, sf_dir), "var_x", "cov_xy", "var_y"), "var_x", "cov_xy", "var_y")
    out = out.withColumns({"reg_trace": F.col("reg_a") + F.col("reg_c"), "reg_det": F.col("reg_a") * F.col("reg_c") - F.col("reg_b") * F.col("reg_b")})
    digits = {"condition_number_raw": 3, "condition_number_reg": 3}
    return out.select("series_id", "day", *[neat(c, digits.get(c, 6)).alias(c) for c in (*eigen.EIGEN_COLUMNS[:5], "reg_trace", "reg_det")], "eigval_2_was_floored", "cov_ok")


_CHAIN = ("series_id", "day", "price", ["tilt", "lines", "wide", "open_share"], "spread")


@query("replay_table")
def replay_table(spark, sf_dir):
    """The diagnostic record of every step."""
    return state.replay_table(chain_inputs(spark, sf_dir), *_CHAIN, "wide", SHORT)


#: The replay's factors, drift and covariance; shares and stress are beyond SQL.
_REPLAY = f"""{STATES_SQL}, {DRIFT_SQL.split(', held AS', 1)[1].join(['held AS', ''])},
    pts AS (SELECT series_id, day, h, i, row_number() OVER (PARTITION BY series_id ORDER BY day) AS row FROM states),
    fin AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY day) AS k, row - coalesce(lag(row) OVER (PARTITION BY series_id ORDER BY day), 0) AS gap FROM pts WHERE h IS NOT NULL AND i IS NOT NULL),
    z AS (SELECT series_id, avg(h) AS mx, avg(i) AS my, var_samp(h) + 1e-8 AS a, covar_samp(h, i) AS b, var_samp(i) + 1e-8 AS c FROM fin WHERE k <= 20 GROUP BY 1),
    walk AS (SELECT series_id, CAST(0 AS BIGINT) AS k, mx, my, a, b, c, CAST(NULL AS DOUBLE) AS dist, CAST(NULL AS DOUBLE) AS w FROM z UNION ALL
      SELECT series_id, k, r * mx + (1 - r) * h, r * my + (1 - r) * i, r * a + (1 - r) * w * w * dx * dx, r * b + (1 - r) * w * w * dx * dy, r * c + (1 - r) * w * w * dy * dy, dist, w FROM (
        SELECT *, least(1.0, 2.5 / greatest(dist, 1e-12)) AS w FROM (
          SELECT s.series_id, s.k, s.h, s.i, f.mx, f.my, f.a, f.b, f.c, s.h - f.mx AS dx, s.i - f.my AS dy, 2 ** (-s.gap / 78.0) AS r,
            sqrt((f.rc * (s.h - f.mx) ** 2 - 2 * f.rb * (s.h - f.mx) * (s.i - f.my) + f.ra * (s.i - f.my) ** 2) / (f.ra * f.rc - f.rb * f.rb)) AS dist
          FROM (SELECT *, share * a + shift AS ra, share * b AS rb, share * c + shift AS rc FROM (SELECT *, e2r - share * e2 AS shift FROM (SELECT *, CASE WHEN e1 > e2 THEN (e1r - e2r) / (e1 - e2) ELSE 0 END AS share
            FROM (SELECT *, greatest(e1, 1e-8) AS e1r, greatest(e2, 1e-4 * greatest(e1, 1e-8), 1e-8) AS e2r FROM (SELECT *, (a + c) / 2 + sqrt((a - c) ** 2 / 4 + b * b) AS e1, (a + c) / 2 - sqrt((a - c) ** 2 / 4 + b * b) AS e2 FROM walk))))) f
          JOIN fin s ON s.series_id = f.series_id AND s.k = f.k + 1))),
    held_k AS (SELECT p.series_id, p.day, p.row, (SELECT count(*) FROM fin WHERE fin.series_id = p.series_id AND fin.row <= p.row) AS k FROM pts p),
    {_EIGEN_ROWS.format('(SELECT * FROM walk WHERE k > 0)', _EIGEN)}"""
_REPLAY_NUMBERS = {"l_t": "liquidity", "t_t": "heat", "p_t": "taste", "h_t": "h", "i_t": "i"}


def _cut(c: str) -> str:
    return f"round(CASE WHEN {c} IS NOT NULL THEN greatest(-1e6, least(1e6, {c})) END, 4) + 0.0"


@query(
    "replay_parts",
    f"""WITH RECURSIVE {_REPLAY} SELECT series_id, day AS week_end, {', '.join(f"{_cut(c)} AS {n}" for n, c in _REPLAY_NUMBERS.items())}, round(drift, 5) + 0.0 AS drift_probe_raw, CAST(coalesce(abs(drift) >= 1.8, false) AS INTEGER) AS drift_flag, k >= 130 AS is_warm,
    round(least(dist, 1e4), 3) + 0.0 AS maha, round(w, 4) + 0.0 AS huber_weight, round(ln(eigval_1), 4) + 0.0 AS log_eigval_1, round(ln(eigval_2_reg), 4) + 0.0 AS log_eigval_2
    FROM states JOIN drift USING (series_id, day) JOIN held_k USING (series_id, day) LEFT JOIN g USING (series_id, k)""",
)
def replay_parts(spark, sf_dir):
    """What SQL can say of the replay: factors, drift, distance, weight and eigenvalues."""
    cut = lambda c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(-1e6), F.least(F.lit(1e6), F.col(c))))
    out = state.replay_table(chain_inputs(spark, sf_dir), *_CHAIN, "wide", SHORT)
    return out.select(
        "series_id", "week_end", *[neat(cut(c), 4).alias(c) for c in _REPLAY_NUMBERS], neat("drift_probe_raw", 5).alias("drift_probe_raw"), "drift_flag", "is_warm",
        neat(F.least(F.col("maha"), F.lit(1e4)), 3).alias("maha"), neat("huber_weight", 4).alias("huber_weight"), neat(F.log("eigval_1"), 4).alias("log_eigval_1"), neat(F.log("eigval_2_reg"), 4).alias("log_eigval_2"),
    )


_SCENARIOS = ("spread_flat", "late_price")
_RUNS_SQL = f"""{DAYS_SQL}, p AS (SELECT *, lag(price, 5) OVER (PARTITION BY series_id ORDER BY day) AS before FROM days), x AS (SELECT series_id, day, s AS scenario,
    CASE s WHEN 'late_price' THEN coalesce(before, price) ELSE price END AS price, CASE s WHEN 'spread_flat' THEN 100000.0 ELSE spread END AS spread FROM p, (SELECT unnest(['base', 'spread_flat', 'late_price']) AS s)),
    t AS (SELECT *, CASE WHEN count(price) OVER w = 26 THEN price / avg(price) OVER w - 1 END AS deviation, CASE WHEN count(spread) OVER v = 52 THEN ln(1 + spread) - ln(1 + avg(spread) OVER v) END AS calm FROM x WINDOW w AS (PARTITION BY series_id, scenario ORDER BY day ROWS 25 PRECEDING), v AS (PARTITION BY series_id, scenario ORDER BY day ROWS 51 PRECEDING)),
    r AS (SELECT *, deviation + calm AS score FROM t),
    diff AS (SELECT o.scenario, series_id, day, o.deviation - b.deviation AS d_deviation, o.calm - b.calm AS d_calm, o.score - b.score AS d_score FROM (SELECT * FROM r WHERE scenario <> 'base') o JOIN (SELECT * FROM r WHERE scenario = 'base') b USING (series_id, day))"""
_SCORED = ["deviation", "calm", "score"]


def _score(rows: DataFrame, run: str) -> DataFrame:
    f = Frames(run, "day")
    made = rows.withColumns({"deviation": f.deviation(F.col("price"), 26), "calm": F.log1p("spread") - F.log1p(f.mean(F.col("spread"), 52))})
    return made.select(run, "day", "deviation", "calm", (F.col("deviation") + F.col("calm")).alias("score"))


def _replayed(spark, sf_dir) -> DataFrame:
    """Scores of each series as it is, with its spread held flat, and with its price five steps late."""
    d = days(spark, sf_dir)
    before = Frames("series_id", "day").lag(F.col("price"), 5)
    changes = {"spread_flat": {"spread": F.lit(100000.0)}, "late_price": {"price": F.coalesce(F.col("before"), F.col("price"))}}
    return scenarios.replayed(d.withColumn("before", before), "series_id", "day", changes, _score)


@query("scenario_differences", f"WITH {_RUNS_SQL} SELECT scenario, series_id, day, " + ", ".join(f"round(d_{c}, 6) + 0.0 AS d_{c}" for c in _SCORED) + " FROM diff")
def scenario_differences(spark, sf_dir):
    out = scenarios.differences(_replayed(spark, sf_dir), "series_id", "day", _SCORED)
    return out.select("scenario", "series_id", "day", *[neat(f"d_{c}").alias(f"d_{c}") for c in _SCORED])


@query("scenario_summary", f"WITH {_RUNS_SQL} SELECT scenario, " + ", ".join(f"count(d_{c}) AS n_{c}, round(avg(abs(d_{c})), 6) + 0.0 AS mean_abs_{c}, round(max(abs(d_{c})), 6) + 0.0 AS max_abs_{c}" for c in _SCORED) + " FROM diff GROUP BY 1")
def scenario_summary(spark, sf_dir):
    diffs = scenarios.differences(_replayed(spark, sf_dir), "series_id", "day", _SCORED)
    out = scenarios.sensitivity_summary(diffs, _SCORED)
    return out.select("scenario", *[x for c in _SCORED for x in (F.col(f"n_{c}"), neat(f"mean_abs_{c}").alias(f"mean_abs_{c}"), neat(f"max_abs_{c}").alias(f"max_abs_{c}"))])


@query("scenario_chain")
def scenario_chain(spark, sf_dir):
    """The whole replay under one replaced input, against the base: mean and largest differences."""
    inputs = chain_inputs(spark, sf_dir)
    late = Frames("series_id", "day").lag(F.col("spread"), 5)
    changes = {"late_spread": {"spread": F.coalesce(F.col("earlier"), F.col("spread"))}}
    inputs = inputs.withColumn("earlier", late)
    run = lambda rows, key: state.replay_table(rows, key, *_CHAIN[1:], "wide", SHORT).withColumnRenamed("week_end", "day")
    made = scenarios.replayed(inputs, "series_id", "day", changes, run)
    columns = ["h_t", "i_t", "s_t", "maha"]
    return scenarios.sensitivity_summary(scenarios.differences(made, "series_id", "day", columns), columns)


_LABELLED = """l AS (SELECT user_id, ts, event_id, event_type AS mode, CASE WHEN value >= 20 THEN CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 AS INTEGER) END AS cluster FROM events),
    n AS (SELECT *, mode || coalesce(':k' || cluster, '') AS label FROM l), c AS (SELECT *, CASE WHEN label = lag(label) OVER w THEN 0 ELSE 1 END AS changed FROM n WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    m AS (SELECT *, sum(changed) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM c),
    r AS (SELECT user_id, run, any_value(label) AS label, any_value(mode) AS mode, any_value(cluster) AS cluster, min(ts) AS start, max(ts) AS finish, count(*) AS steps FROM m GROUP BY 1, 2),
    runs AS (SELECT *, run = max(run) OVER (PARTITION BY user_id) AS is_open FROM r)"""


def _regimes(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    parity = (F.get_json_object("props", "$.k").cast("long") % 2).cast("int")
    rows = e.select("user_id", "ts", "event_id", F.col("event_type").alias("mode"), F.when(F.col("value") >= 20, parity).alias("cluster"))
    return regimes.labelled_runs(rows, "user_id", ["ts", "event_id"], "mode", "cluster")


@query(
    "regime_summary",
    f"""WITH {_LABELLED} SELECT label, mode, cluster, count(*) AS run_count, min(steps) AS min_steps, median(steps) AS median_steps, round(avg(steps), 6) + 0.0 AS mean_steps, max(steps) AS max_steps,
    count(*) FILTER (NOT is_open) AS closed_count, median(steps) FILTER (NOT is_open) AS closed_median, max(steps) FILTER (NOT is_open) AS closed_max,
    max((finish, start, steps))[2] AS latest_start, max(finish) AS latest_finish, max((finish, start, steps))[3] AS latest_steps FROM runs GROUP BY 1, 2, 3""",
)
def regime_summary(spark, sf_dir):
    """Durations per composite label, closed runs apart, and each label's latest run."""
    return regimes.duration_summary(_regimes(spark, sf_dir)).withColumn("mean_steps", neat("mean_steps"))


@query(
    "running_regimes",
    f"""WITH {_LABELLED} SELECT o.user_id, o.label, o.mode, o.cluster, o.start, o.finish, o.steps, count(c.steps) AS closed_runs, round(CAST(count(*) FILTER (c.steps <= o.steps) AS DOUBLE) / nullif(count(c.steps), 0), 6) + 0.0 AS percentile
    FROM (SELECT * FROM runs WHERE is_open) o LEFT JOIN (SELECT * FROM runs WHERE NOT is_open) c ON o.label = c.label GROUP BY ALL""",
)
def running_regimes(spark, sf_dir):
    """Each user's open run among the closed runs of its label."""
    return regimes.running_regimes(_regimes(spark, sf_dir), "user_id").withColumn("percentile", neat("percentile"))


_RATES = ["tilt", "wide", "open_share"]
_SCORES = ["tilt", "move", "wide", "open_share", "u_short", "u_long", "u_trend", "rv", "spread"]
STAGES = [
    warmup.Stage("u_short", ("price",), SHORT.short_mean),
    warmup.Stage("u_long", ("price",), SHORT.long_mean),
    warmup.Stage("u_trend", ("price",), SHORT.trend_mean),
    # Returns need a step before them.
    warmup.Stage("rv", ("price",), 21),
    warmup.Stage("move", ("lines",), 5),
    # A robust score looks at rows before its own.
    *[warmup.Stage(f"d_{c}", (c,), SHORT.robust, 1) for c in _SCORES],
    warmup.Stage("liquidity", ("d_tilt", "d_move", "d_wide", "d_open_share")),
    warmup.Stage("heat", ("d_u_short", "d_u_long")),
    warmup.Stage("taste", ("d_u_trend", "d_spread", "d_rv")),
    warmup.Stage("h", ("liquidity", "heat", "taste")),
    warmup.Stage("i", ("liquidity", "heat", "taste"), 5),
    warmup.Stage("warm", ("h", "i"), SHORT.warmup),
    warmup.Stage("shares", ("warm",), 1, 1),
]
#: The same by hand, from the first row on: rows, binding parent and binding input of each stage.
_READY = {
    "u_short": (26, "price", "price"), "u_long": (78, "price", "price"), "u_trend": (20, "price", "price"), "rv": (21, "price", "price"), "move": (5, "lines", "lines"),
    "d_tilt": (53, "tilt", "tilt"), "d_move": (57, "move", "lines"), "d_wide": (53, "wide", "wide"), "d_open_share": (53, "open_share", "open_share"), "d_u_short": (78, "u_short", "price"),
    "d_u_long": (130, "u_long", "price"), "d_u_trend": (72, "u_trend", "price"), "d_rv": (73, "rv", "price"), "d_spread": (53, "spread", "spread"),
    "liquidity": (57, "d_move", "lines"), "heat": (130, "d_u_long", "price"), "taste": (73, "d_rv", "price"), "h": (130, "heat", "price"), "i": (134, "heat", "price"), "warm": (263, "i", "price"), "shares": (264, "warm", "price"),
}
_READY_SQL = ", ".join(f"('{s}', {n}, '{p}', '{b}')" for s, (n, p, b) in _READY.items())


@query(
    "warmup_graph",
    f"""WITH RECURSIVE {STATES_SQL}, g AS (SELECT * FROM (VALUES {_READY_SQL}) v(stage, ready_row, binding_parent, binding_input)), k AS (SELECT series_id, day, row_number() OVER (PARTITION BY series_id ORDER BY day) AS i FROM days),
    seen AS (SELECT series_id, unnest(['liquidity', 'heat', 'taste', 'h', 'i']) AS stage, unnest([min(day) FILTER (liquidity IS NOT NULL), min(day) FILTER (heat IS NOT NULL), min(day) FILTER (taste IS NOT NULL), min(day) FILTER (h IS NOT NULL), min(day) FILTER (i IS NOT NULL)]) AS observed FROM states GROUP BY 1)
    SELECT s.series_id, g.stage, CAST(g.ready_row AS BIGINT) AS ready_row, k.day AS ready, g.binding_parent, g.binding_input, seen.observed FROM (SELECT DISTINCT series_id FROM days) s CROSS JOIN g LEFT JOIN k ON k.series_id = s.series_id AND k.i = g.ready_row LEFT JOIN seen ON seen.series_id = s.series_id AND seen.stage = g.stage""",
)
def warmup_graph(spark, sf_dir):
    """When every stage of the chain can be known, what holds it back, and when it is known."""
    states = state.state(chain_inputs(spark, sf_dir), *_CHAIN, SHORT)
    inputs = ["price", "lines", "spread", *_RATES]
    rows = states.select("series_id", "day", *inputs, "liquidity", "heat", "taste", "h", "i")
    out = warmup.dependency_map(rows, "series_id", "day", inputs, STAGES)
    return out.select("series_id", "stage", F.col("ready_row").cast("long").alias("ready_row"), "ready", "binding_parent", "binding_input", "observed")


@query("warmup_chain", f"WITH {DAYS_SQL} SELECT DISTINCT series_id, 'shares <- warm <- i <- heat <- d_u_long <- u_long <- price' AS chain FROM days")
def warmup_chain(spark, sf_dir):
    """The stages that hold back the last one, down to the input."""
    inputs = ["price", "lines", "spread", *_RATES]
    rows = chain_inputs(spark, sf_dir).select("series_id", "day", *inputs)
    return warmup.explained(warmup.dependency_map(rows, "series_id", "day", inputs, STAGES), "series_id", "shares")


@query(
    "week_routes",
    f"""WITH {SNAPS_SQL} SELECT run_id, CASE WHEN backfill_mode IS NULL THEN CASE WHEN k_hat IS NOT NULL THEN 'legacy_cache_micro' ELSE 'none' END WHEN backfill_mode = 'strict_recovery' AND strict_gate_passed THEN 'stores_strict' WHEN backfill_mode = 'degraded_backfill' THEN 'stores_backfill' ELSE 'controlled_block' END AS store,
    CASE WHEN backfill_mode = 'degraded_backfill' THEN backfill_mode WHEN backfill_mode = 'strict_recovery' AND strict_gate_passed THEN backfill_mode WHEN backfill_mode IS NOT NULL THEN 'block' END AS scheme, coalesce(backfill_mode = 'strict_recovery' AND strict_gate_passed, false) AS strict_ok,
    CASE WHEN backfill_mode IS NULL THEN CASE WHEN k_hat IS NOT NULL THEN 'legacy_cache_micro_used_for_non_controlled_week' ELSE 'legacy_cache_micro_missing' END WHEN backfill_mode = 'strict_recovery' THEN CASE WHEN strict_gate_passed THEN 'strict_store_gate_passed' ELSE 'strict_store_gate_failed:' || execution_state END
      WHEN backfill_mode = 'degraded_backfill' THEN 'controlled_degraded_backfill_freezes_micro' ELSE 'controlled_block_prevents_strict_contracts' END AS reason FROM snaps""",
)
def week_routes(spark, sf_dir):
    """The store that every run of every week is read from."""
    runs = snapshots(spark, sf_dir).withColumn("has_legacy", F.col("k_hat").isNotNull())
    return routing.routed(runs, "backfill_mode", "strict_gate_passed", "execution_state", "has_legacy").select("run_id", "store", "scheme", "strict_ok", "reason")
