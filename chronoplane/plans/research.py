"""Queries on realised and forward measures, separation of states and predictive power."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoplane.operators import research
from chronoplane.plans.inputs import DAYS_SQL, WEEKS_SQL, days, weeks
from chronoplane.plans.registry import neat, query

_METRICS = ("r1w", "R4w", "sigma4w", "mdd8w")
_HORIZONS = [1, 4, 8]
_AXIS = f"""{DAYS_SQL}, {WEEKS_SQL}, px AS (SELECT series_id, day, price, ln(price / lag(price) OVER (PARTITION BY series_id ORDER BY day)) AS r FROM days), ask AS (SELECT series_id, week_end AS day FROM weeks)"""
_REAL = f"""{_AXIS}, h AS (SELECT a.series_id, a.day, p.day AS pd, p.price, p.r FROM ask a JOIN px p ON p.series_id = a.series_id AND p.day <= a.day),
    m8 AS (SELECT *, max(price) OVER (PARTITION BY series_id, day ORDER BY pd) AS peak FROM h WHERE pd > day - 56), f8 AS (SELECT series_id, day, count(*) AS n, max(1 - price / peak) AS fall FROM m8 GROUP BY 1, 2),
    m4 AS (SELECT *, row_number() OVER (PARTITION BY series_id, day ORDER BY pd) AS i FROM h WHERE pd > day - 28), s4 AS (SELECT series_id, day, stddev_samp(r) FILTER (i > 1) * sqrt(52e0) AS sigma FROM m4 GROUP BY 1, 2),
    b AS (SELECT series_id, day, count(*) AS n, arg_max(price, pd) AS now, arg_max(price, pd) FILTER (pd <= day - 5) AS p1, arg_max(price, pd) FILTER (pd <= day - 25) AS p4 FROM h GROUP BY 1, 2),
    realized AS (SELECT a.series_id, a.day, CASE WHEN b.n >= 2 THEN ln(now / p1) END AS r1w, CASE WHEN b.n >= 2 THEN ln(now / p4) END AS "R4w", CASE WHEN b.n >= 2 THEN sigma END AS sigma4w, CASE WHEN b.n >= 2 AND f8.n >= 2 THEN fall END AS mdd8w
      FROM ask a LEFT JOIN b USING (series_id, day) LEFT JOIN s4 USING (series_id, day) LEFT JOIN f8 USING (series_id, day))"""


def _asked(spark, sf_dir):
    return weeks(spark, sf_dir).select("series_id", F.col("week_end").alias("day"))


def _realized(spark, sf_dir):
    return research.realized_set(days(spark, sf_dir), _asked(spark, sf_dir), "series_id", "day", "price")


@query("realized_metrics", f"WITH {_REAL} SELECT series_id, day, " + ", ".join(f'round("{m}", 6) + 0.0 AS "{m}"' for m in _METRICS) + " FROM realized")
def realized_metrics(spark, sf_dir):
    return _realized(spark, sf_dir).withColumns({m: neat(m) for m in _METRICS})


def _forward_sql(h: int) -> str:
    return f"""x{h} AS (SELECT a.series_id, a.day, p.day AS pd, p.price, p.r, (SELECT arg_max(q.price, q.day) FROM px q WHERE q.series_id = a.series_id AND q.day <= a.day) AS now FROM ask a JOIN px p ON p.series_id = a.series_id AND p.day > a.day AND p.day <= a.day + {7 * h}),
    y{h} AS (SELECT *, greatest(now, max(price) OVER w) AS peak, row_number() OVER w AS i FROM x{h} WINDOW w AS (PARTITION BY series_id, day ORDER BY pd)),
    z{h} AS (SELECT series_id, day, ln(arg_max(price, pd) / any_value(now)) AS fwd_ret_{h}w, stddev_samp(r) FILTER (i > 1) * sqrt(52e0) AS fwd_vol_{h}w, max(greatest(0, 1 - price / peak)) AS fwd_mdd_{h}w FROM y{h} GROUP BY 1, 2)"""


_TARGETS = [f"fwd_{b}_{h}w" for h in _HORIZONS for b in ("ret", "vol", "mdd")]
_FWD = ", ".join(_forward_sql(h) for h in _HORIZONS) + ", forward AS (SELECT a.series_id, a.day, " + ", ".join(_TARGETS) + " FROM ask a " + " ".join(f"LEFT JOIN z{h} USING (series_id, day)" for h in _HORIZONS) + ")"


def _forward(spark, sf_dir):
    return research.forward_set(days(spark, sf_dir), _asked(spark, sf_dir), "series_id", "day", "price", _HORIZONS)


@query("forward_metrics", f"WITH {_AXIS}, {_FWD} SELECT series_id, day, " + ", ".join(f"round({t}, 6) + 0.0 AS {t}" for t in _TARGETS) + " FROM forward")
def forward_metrics(spark, sf_dir):
    return _forward(spark, sf_dir).withColumns({t: neat(t) for t in _TARGETS})


#: A week's state goes by its last fall, so that states differ.
_LONG = f"""{_REAL}, states AS (SELECT *, CAST(least(4, floor(5 * coalesce(mdd8w, 0) + CAST(dayofyear(day) % 2 AS INTEGER))) AS INTEGER) AS state FROM realized),
    long AS (SELECT metric, state, value FROM (SELECT state, unnest(['r1w', 'R4w', 'sigma4w', 'mdd8w']) AS metric, unnest([r1w, "R4w", sigma4w, mdd8w]) AS value FROM states) WHERE value IS NOT NULL)"""


def _long(spark, sf_dir):
    state = F.least(F.lit(4), F.floor(5 * F.coalesce("mdd8w", F.lit(0.0)) + F.dayofyear("day") % 2)).cast("int")
    real = _realized(spark, sf_dir).withColumn("state", state)
    return real.select("state", *_METRICS).unpivot(["state"], list(_METRICS), "metric", "value")


@query(
    "state_descriptives",
    f"WITH {_LONG} SELECT metric, state, count(*) AS n_obs, round(median(value), 6) + 0.0 AS median, round(quantile_cont(value, 0.25), 6) + 0.0 AS q25, round(quantile_cont(value, 0.75), 6) + 0.0 AS q75 FROM long GROUP BY 1, 2",
)
def state_descriptives(spark, sf_dir):
    return research.state_descriptives(_long(spark, sf_dir)).withColumns({c: neat(c) for c in ("median", "q25", "q75")})


_PHI = "(({0}) * (0.254829592e0 + ({0}) * (-0.284496736e0 + ({0}) * (1.421413741e0 + ({0}) * (-1.453152027e0 + ({0}) * 1.061405429e0)))))"


def _tail(z: str) -> str:
    return f"({_PHI.format(f'(1 / (1 + 0.3275911e0 * abs({z}) / sqrt(2e0)))')} * exp(-({z}) * ({z}) / 2e0))"


_CHI = f"""CASE n_states - 1 WHEN 1 THEN {_tail('sqrt(x)')} WHEN 2 THEN exp(-x / 2) WHEN 3 THEN {_tail('sqrt(x)')} + 2 * exp(-x / 2) / sqrt(2e0 * pi()) * sqrt(x) WHEN 4 THEN exp(-x / 2) * (1 + x / 2) END"""
_KW = f"""g AS (SELECT *, count(*) OVER (PARTITION BY metric, state) AS c FROM long), k AS (SELECT metric, state, rank() OVER (PARTITION BY metric ORDER BY value) + (count(*) OVER (PARTITION BY metric, value) - 1) / 2e0 AS r FROM g WHERE c >= 3),
    t AS (SELECT metric, CAST(sum(c) AS BIGINT) AS total, sum(CAST(c * c * c - c AS DOUBLE)) AS ties FROM (SELECT metric, value, count(*) AS c FROM g WHERE c >= 3 GROUP BY 1, 2) GROUP BY 1), s AS (SELECT metric, state, count(*) AS n, sum(r) AS rs FROM k GROUP BY 1, 2),
    u AS (SELECT metric, any_value(total) AS total, any_value(ties) AS ties, count(*) AS n_states, sum(rs * rs / n) AS s FROM s JOIN t USING (metric) GROUP BY 1),
    v AS (SELECT metric, total, n_states, (12e0 / (total * (total + 1e0)) * s - 3 * (total + 1)) / (1 - ties / (CAST(total AS DOUBLE) ** 3 - total)) AS x FROM u), tests AS (SELECT metric, total, n_states, x AS kw_stat, {_CHI} AS kw_pvalue FROM v)"""


@query("state_separation", f"WITH {_LONG}, {_KW} SELECT metric, total, n_states, round(kw_stat, 6) + 0.0 AS kw_stat, round(kw_pvalue, 6) + 0.0 AS kw_pvalue FROM tests")
def state_separation(spark, sf_dir):
    return research.separation(_long(spark, sf_dir)).withColumns({c: neat(c) for c in ("kw_stat", "kw_pvalue")})


_PAIRS = f"""ka AS (SELECT metric, state, value, rank() OVER (PARTITION BY metric ORDER BY value) + (count(*) OVER (PARTITION BY metric, value) - 1) / 2e0 AS r FROM long), ta AS (SELECT metric, CAST(sum(c) AS DOUBLE) AS total, sum(CAST(c * c * c - c AS DOUBLE)) AS ties FROM (SELECT metric, value, count(*) AS c FROM long GROUP BY 1, 2) GROUP BY 1),
    sa AS (SELECT metric, state, count(*) AS n, avg(r) AS mean FROM ka GROUP BY 1, 2), pa AS (SELECT metric, total, ties, i AS state_i, j AS state_j FROM ta, (SELECT i, j FROM range(5) a(i), range(5) b(j) WHERE i < j)),
    za AS (SELECT pa.*, a.n AS na, b.n AS nb, CASE WHEN a.n >= 2 AND b.n >= 2 THEN (a.mean - b.mean) / sqrt((total * (total + 1) / 12 - ties / (12 * (total - 1))) * (1e0 / a.n + 1e0 / b.n)) END AS z FROM pa LEFT JOIN sa a ON a.metric = pa.metric AND a.state = state_i LEFT JOIN sa b ON b.metric = pa.metric AND b.state = state_j),
    qa AS (SELECT *, coalesce({_tail('z')}, 1) AS p FROM za), ha AS (SELECT *, least(1e0, p * (count(*) OVER (PARTITION BY metric) - row_number() OVER w + 1)) AS h FROM qa WINDOW w AS (PARTITION BY metric ORDER BY p, state_i, state_j)),
    pairs AS (SELECT *, max(h) OVER (PARTITION BY metric ORDER BY p, state_i, state_j) AS holm, (SELECT avg(sign(x.value - y.value)) FROM long x, long y WHERE x.metric = ha.metric AND y.metric = ha.metric AND x.state = ha.state_i AND y.state = ha.state_j) AS cd FROM ha)"""


@query(
    "state_pairs",
    f"WITH {_LONG}, {_PAIRS} SELECT metric, CAST(state_i AS INTEGER) AS state_i, CAST(state_j AS INTEGER) AS state_j, round(z, 6) + 0.0 AS z_stat, round(p, 6) + 0.0 AS pvalue_raw, round(holm, 6) + 0.0 AS pvalue_holm, holm < 0.05 AS significant, round(cd, 6) + 0.0 AS cliffs_delta FROM pairs",
)
def state_pairs(spark, sf_dir):
    return research.pairwise(_long(spark, sf_dir)).withColumns({c: neat(c) for c in ("z_stat", "pvalue_raw", "pvalue_holm", "cliffs_delta")})


@query(
    "separation_verdict",
    f"""WITH {_LONG}, {_KW}, {_PAIRS}, f AS (SELECT metric, bool_or(holm < 0.05) AS a, bool_or(holm < 0.05 AND state_i IN (0, 1) AND state_j IN (3, 4)) AS far FROM pairs GROUP BY 1), bb AS (SELECT * FROM tests JOIN f USING (metric) WHERE metric IN ('sigma4w', 'mdd8w')),
    o AS (SELECT bool_or(metric = 'sigma4w' AND kw_pvalue < 0.05 AND a) AS sigma_ok, bool_or(metric = 'mdd8w' AND kw_pvalue < 0.05 AND a) AS mdd_ok, bool_or(far) AS low_high_ok FROM bb) SELECT *, sigma_ok AND mdd_ok AND low_high_ok AS passed FROM o""",
)
def separation_verdict(spark, sf_dir):
    long = _long(spark, sf_dir)
    return research.separation_passes(research.separation(long), research.pairwise(long))


_SIGNALS = ["spread", "open_share", "n_orders"]


def _grid(spark, sf_dir):
    signals = weeks(spark, sf_dir).select("series_id", F.col("week_end").alias("day"), *_SIGNALS)
    return _forward(spark, sf_dir).join(signals, ["series_id", "day"])


_ROWS = f"""{_AXIS}, {_FWD}, base AS (SELECT f.*, w.spread, w.open_share, w.n_orders FROM forward f JOIN weeks w ON w.series_id = f.series_id AND w.week_end = f.day),
    grid AS ({' UNION ALL '.join(f"SELECT series_id, day, open_share > 0.3 AS hc, '{s}' AS signal, CAST({s} AS DOUBLE) AS x, {h} AS h, '{t}' AS target, {t} AS y FROM base" for s in _SIGNALS for h in _HORIZONS for t in _TARGETS if t.endswith(f'_{h}w'))}),
    cells AS (SELECT *, 'full' AS subsample FROM grid WHERE x IS NOT NULL AND y IS NOT NULL UNION ALL SELECT *, 'high_conf' FROM grid WHERE x IS NOT NULL AND y IS NOT NULL AND hc),
    lines AS (SELECT series_id, signal, h, target, subsample, count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(x) AS mx, quantile_cont(x, 0.333) AS lo, quantile_cont(x, 0.667) AS hi FROM cells GROUP BY 1, 2, 3, 4, 5),
    res AS (SELECT c.*, l.n, l.b, l.lo, l.hi, c.x - mx AS cx, (c.x - mx) * (c.y - a - b * c.x) AS g FROM cells c JOIN lines l USING (series_id, signal, h, target, subsample)),
    lag_ AS (SELECT *, {', '.join(f'coalesce(lag(g, {j}) OVER w, 0) AS l{j}' for j in range(1, 8))} FROM res WINDOW w AS (PARTITION BY series_id, signal, h, target, subsample ORDER BY day)),
    se AS (SELECT series_id, signal, h, target, subsample, any_value(n) AS n, any_value(b) AS b, sqrt(sum(g * g) + CASE WHEN h = 8 THEN {' + '.join(f'{2 * (1 - j / 8)!r}e0 * sum(g * l{j})' for j in range(1, 8))} ELSE {' + '.join(f'{2 * (1 - j / 5)!r}e0 * sum(g * l{j})' for j in range(1, 5))} END) / sum(cx * cx) AS se,
      median(y) FILTER (x <= lo) AS bot, median(y) FILTER (x >= hi) AS top FROM lag_ GROUP BY 1, 2, 3, 4, 5),
    rk AS (SELECT series_id, signal, h, target, subsample, rank() OVER (w ORDER BY x) + (count(*) OVER (PARTITION BY series_id, signal, h, target, subsample, x) - 1) / 2e0 AS rx, rank() OVER (w ORDER BY y) + (count(*) OVER (PARTITION BY series_id, signal, h, target, subsample, y) - 1) / 2e0 AS ry FROM cells WINDOW w AS (PARTITION BY series_id, signal, h, target, subsample)),
    rho AS (SELECT series_id, signal, h, target, subsample, corr(rx, ry) AS rho FROM rk GROUP BY 1, 2, 3, 4, 5),
    rows_ AS (SELECT series_id, signal, h, target, subsample, n, CASE WHEN n >= 10 THEN rho END AS rho, CASE WHEN n >= 10 THEN b END AS b, CASE WHEN n >= 10 THEN b / se END AS t, CASE WHEN n >= 10 THEN {_tail('(b / se)')} END AS p, CASE WHEN n >= 10 THEN bot END AS bot, CASE WHEN n >= 10 THEN top END AS top FROM se JOIN rho USING (series_id, signal, h, target, subsample))"""


@query(
    "predictive_rows",
    f"""WITH {_ROWS} SELECT series_id, signal, CAST(h AS INTEGER) AS horizon_weeks, target, subsample, n AS n_obs, round(rho, 6) + 0.0 AS spearman_rho, round(b, 9) + 0.0 AS ols_beta, round(t, 5) + 0.0 AS hac_tstat, round(p, 5) + 0.0 AS hac_pvalue,
    round(bot, 6) + 0.0 AS tercile_bottom_median, round(top, 6) + 0.0 AS tercile_top_median, round(top - bot, 6) + 0.0 AS tercile_spread FROM rows_""",
)
def predictive_rows(spark, sf_dir):
    out = research.predictive_rows(_grid(spark, sf_dir), "day", _SIGNALS, _HORIZONS, ["fwd_ret", "fwd_vol", "fwd_mdd"], F.col("open_share") > 0.3, "series_id")
    digits = {"ols_beta": 9, "hac_tstat": 5, "hac_pvalue": 5}
    return out.withColumns({c: neat(c, digits.get(c, 6)) for c in ("spearman_rho", "ols_beta", "hac_tstat", "hac_pvalue", "tercile_bottom_median", "tercile_top_median", "tercile_spread")})


@query(
    "predictive_verdict",
    f"""WITH {_ROWS}, f AS (SELECT a.*, o.b AS other FROM rows_ a JOIN rows_ o USING (series_id, signal, h, target) WHERE a.subsample = 'full' AND o.subsample = 'high_conf' AND h IN (4, 8) AND regexp_matches(target, '^fwd_(vol|mdd)_')),
    g AS (SELECT coalesce(b > 0 AND p < 0.10 AND top - bot > 0 AND NOT coalesce(other * b < 0, false), false) AS good, series_id FROM f) SELECT series_id, count(*) AS n_candidates, count(*) FILTER (good) AS n_passing, bool_or(good) AS passed FROM g GROUP BY 1""",
)
def predictive_verdict(spark, sf_dir):
    rows = research.predictive_rows(_grid(spark, sf_dir), "day", _SIGNALS, _HORIZONS, ["fwd_ret", "fwd_vol", "fwd_mdd"], F.col("open_share") > 0.3, "series_id")
    return research.predictive_passes(rows, _SIGNALS, "series_id")
