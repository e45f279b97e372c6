"""Queries on entities, freshness, decisions, scalars and the full decision chain."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoplane.functions import recursions as rec
from chronoplane.functions import scalars
from chronoplane.operators import holdings, ops, resolve, state
from chronoplane.operators.folds import run_fold
from chronoplane.plans.inputs import DAYS_SQL, PANEL_SQL, days, panel
from chronoplane.plans.registry import neat, query, table

_RAW = """raw AS (SELECT c_custkey AS row_id, c_nationkey AS book, upper(trim(CASE WHEN c_custkey % 5 = 0 THEN '' ELSE ' sym' || CAST(1 + c_custkey % 150 AS VARCHAR) || ' ' END)) AS symbol,
    CASE WHEN c_custkey % 3 = 0 THEN 'ISIN' || CAST(1 + c_custkey % 170 AS VARCHAR) ELSE '' END AS isin, 1.0 / count(*) OVER (PARTITION BY c_nationkey) AS weight FROM customer),
    master AS (SELECT 'I' || s_suppkey AS instrument_id, 'SYM' || s_suppkey AS symbol, 'ISIN' || s_suppkey AS isin, DATE '1995-01-01' + CAST(s_suppkey % 900 AS INTEGER) AS active_from, CASE WHEN s_suppkey % 4 = 0 THEN DATE '1998-01-01' END AS active_to FROM supplier),
    live AS (SELECT * FROM master WHERE active_from <= DATE '1997-01-01' AND (active_to IS NULL OR DATE '1997-01-01' <= active_to)),
    hit AS (SELECT raw.*, a.instrument_id AS ia, b.instrument_id AS ib FROM raw LEFT JOIN live a ON raw.isin = a.isin AND raw.isin <> '' LEFT JOIN live b ON raw.symbol = b.symbol AND raw.symbol <> ''),
    resolved AS (SELECT row_id, book, weight, coalesce(ia, ib) AS instrument_id, CASE WHEN ia IS NOT NULL THEN 'isin' WHEN ib IS NOT NULL THEN 'symbol' ELSE 'unresolved' END AS source FROM hit)"""


def _resolved(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    symbol = F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.concat(F.lit(" sym"), 1 + F.col("c_custkey") % 150, F.lit(" ")))
    isin = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("ISIN"), 1 + F.col("c_custkey") % 170)).otherwise("")
    raw = c.select(F.col("c_custkey").alias("row_id"), F.col("c_nationkey").alias("book"), resolve.clean_upper(symbol).alias("symbol"), isin.alias("isin"), (1.0 / F.count(F.lit(1)).over(Window.partitionBy("c_nationkey"))).alias("weight"))
    master = s.select(
        F.concat(F.lit("I"), "s_suppkey").alias("instrument_id"), F.concat(F.lit("SYM"), "s_suppkey").alias("symbol"), F.concat(F.lit("ISIN"), "s_suppkey").alias("isin"),
        F.date_add(F.lit("1995-01-01").cast("date"), (F.col("s_suppkey") % 900).cast("int")).alias("active_from"), F.when(F.col("s_suppkey") % 4 == 0, F.lit("1998-01-01").cast("date")).alias("active_to"),
    )
    live = master.where(resolve.active(F.lit("1997-01-01").cast("date")))
    return resolve.cascade(raw, [("isin", "isin", live, "isin"), ("symbol", "symbol", live, "symbol")])


@query("namespace_cascade", f"WITH {_RAW} SELECT row_id, instrument_id, source FROM resolved")
def namespace_cascade(spark, sf_dir):
    return _resolved(spark, sf_dir).select("row_id", "instrument_id", "source")


@query(
    "weight_unit",
    f"""WITH {PANEL_SQL}, p AS (SELECT day, ticker, CASE WHEN month(day) % 3 = 0 THEN 100 * weight WHEN month(day) % 3 = 1 THEN weight ELSE 7 * weight END AS w FROM panel), t AS (SELECT *, sum(w) OVER (PARTITION BY day) AS total FROM p)
    SELECT day, ticker, CASE WHEN total BETWEEN 0.99 AND 1.01 THEN 1.0::DOUBLE WHEN total BETWEEN 99 AND 101 THEN 100.0::DOUBLE END AS unit, round(w / CASE WHEN total BETWEEN 0.99 AND 1.01 THEN 1.0::DOUBLE WHEN total BETWEEN 99 AND 101 THEN 100.0::DOUBLE END, 6) + 0.0 AS share FROM t""",
)
def weight_unit(spark, sf_dir):
    m = F.month("day") % 3
    raw = panel(spark, sf_dir).select("day", "ticker", (F.when(m == 0, 100 * F.col("weight")).when(m == 1, F.col("weight")).otherwise(7 * F.col("weight"))).alias("w"))
    return holdings.unit_of(raw, ["day"], "w").select("day", "ticker", "unit", neat("share").alias("share"))


@query(
    "store_gate",
    f"""WITH {PANEL_SQL}, m AS (SELECT day, CASE WHEN ticker = month(day) THEN ticker + 1000 ELSE ticker END AS ticker FROM panel), s AS (SELECT p.day, count(*) AS k FROM panel p WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.day = p.day AND m.ticker = p.ticker) GROUP BY 1)
    SELECT p.day, count(*) AS n, coalesce(any_value(k), 0) AS n_stray, coalesce(any_value(k), 0) = 0 AND sum(weight) BETWEEN 0.99 AND 1.01 AS open FROM panel p LEFT JOIN s USING (day) GROUP BY 1""",
)
def store_gate(spark, sf_dir):
    p = panel(spark, sf_dir)
    return resolve.store_gate(p, p.select("day", F.when(F.col("ticker") == F.month("day"), F.col("ticker") + 1000).otherwise(F.col("ticker")).alias("ticker")), "day", "ticker", "weight").select("day", "n", "n_stray", "open")


_FRESH = """f AS (SELECT user_id, event_type, CAST(max(ts) AS DATE) AS last_seen FROM events GROUP BY 1, 2), l AS (SELECT *, last_seen >= DATE '2024-01-24' AS fresh,
    CASE WHEN last_seen >= DATE '2024-01-24' THEN 'ok' WHEN event_type IN ('purchase') THEN 'block' ELSE 'degrade' END AS level FROM f),
    x AS (SELECT user_id, CASE WHEN bool_or(level = 'block') THEN 'block' WHEN bool_or(level = 'degrade') THEN 'degrade' ELSE 'execute' END AS state, coalesce(string_agg(event_type || ':' || level, ';' ORDER BY event_type) FILTER (level <> 'ok'), '') AS reasons FROM l GROUP BY 1)"""


def _execution(spark, sf_dir):
    seen = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    per = seen.groupBy("user_id", "event_type").agg(F.max("day").alias("day"))
    # A source is one event type of one user.
    fresh = F.coalesce(F.col("day") >= F.lit("2024-01-24").cast("date"), F.lit(False))
    rows = per.withColumn("level", F.when(fresh, "ok").when(F.col("event_type").isin("purchase"), "block").otherwise("degrade"))
    return ops.execution_state(rows, ["user_id"], "event_type")


@query("freshness_sources", "SELECT event_type, CAST(max(ts) AS DATE) AS last_seen, CAST(max(ts) AS DATE) >= DATE '2024-01-30' AS fresh, CASE WHEN CAST(max(ts) AS DATE) >= DATE '2024-01-30' THEN 'ok' WHEN event_type = 'purchase' THEN 'block' ELSE 'degrade' END AS level FROM events GROUP BY 1")
def freshness_sources(spark, sf_dir):
    seen = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return ops.freshness(seen, "event_type", "day", F.lit("2024-01-30").cast("date"), ["purchase"])


@query("execution_state", f"WITH {_FRESH} SELECT * FROM x")
def execution_state(spark, sf_dir):
    return _execution(spark, sf_dir)


@query("backfill_decision", f"WITH {_FRESH}, v AS (SELECT user_id, state, CASE user_id % 3 WHEN 0 THEN 'passed_strict' WHEN 1 THEN 'passed_degraded_only' ELSE 'failed' END AS verdict FROM x) SELECT user_id, CASE WHEN state = 'execute' AND verdict = 'passed_strict' THEN 'strict' WHEN verdict IN ('passed_strict', 'passed_degraded_only') THEN 'degraded' ELSE 'block' END AS scheme FROM v")
def backfill_decision(spark, sf_dir):
    verdict = F.when(F.col("user_id") % 3 == 0, "passed_strict").when(F.col("user_id") % 3 == 1, "passed_degraded_only").otherwise("failed")
    return _execution(spark, sf_dir).select("user_id", ops.backfill_decision(F.col("state") == "execute", verdict).alias("scheme"))


@query(
    "scalar_functions",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, sha256(concat_ws('|', CAST(event_id AS VARCHAR), event_type)) AS digest, CASE WHEN length(props) > 7 THEN left(props, 4) || '...' ELSE props END AS short,
    regexp_matches(props, '(/home/|token=)') AS flagged, strptime(strftime(ts, '%Y%m%d%H%M%S'), '%Y%m%d%H%M%S') AS at FROM events""",
)
def scalar_functions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), scalars.digest(F.col("event_id").cast("string"), F.col("event_type")).alias("digest"), scalars.truncated(F.col("props"), 7).alias("short"),
        scalars.is_sensitive(F.col("props")).alias("flagged"), scalars.compact_timestamp(F.date_format("ts", "yyyyMMddHHmmss")).alias("at"))


@query("host_allow_list", "SELECT page_id, regexp_matches(url, '^https?://([^/]*\\.)?example\\.com([/:?#]|$)') AS allowed FROM pages")
def host_allow_list(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", scalars.host_allowed(F.col("url"), ["example.com"]).alias("allowed"))


SHORT = state.Lengths(robust=52, half_life=104, short_mean=26, long_mean=78, trend_mean=20, rank=156, stress=78, warmup=130)


def chain_inputs(spark, sf_dir):
    d = days(spark, sf_dir)
    return d.withColumn("lines", F.log1p(F.col("n_orders").cast("double") + F.col("spread") / 1e5)).withColumn("tilt", F.col("price") / 1e5 + F.col("open_share")).withColumn("wide", F.log1p("spread") + F.col("price") / 1e6)


_USED = ["tilt", "move", "wide", "open_share", "u_short", "u_long", "u_trend", "rv", "spread"]
_AT = "OVER (PARTITION BY series_id ORDER BY day ROWS BETWEEN {0} PRECEDING AND {1})"


def _deviation(n: int) -> str:
    w = _AT.format(n - 1, "CURRENT ROW")
    return f"CASE WHEN count(price) {w} = {n} THEN price / avg(price) {w} - 1 END"


RAW_FACTORS_SQL = f"""{DAYS_SQL}, inp AS (SELECT *, ln(1 + n_orders + spread / 1e5) AS lines, price / 1e5 + open_share AS tilt, ln(1 + spread) + price / 1e6 AS wide, ln(price / lag(price) OVER (PARTITION BY series_id ORDER BY day)) AS step FROM days),
    fac AS (SELECT series_id, day, tilt, wide, open_share, spread, lines - lag(lines, 4) OVER (PARTITION BY series_id ORDER BY day) AS move, {_deviation(26)} AS u_short, {_deviation(78)} AS u_long, {_deviation(20)} AS u_trend,
      CASE WHEN count(step) {_AT.format(19, 'CURRENT ROW')} = 20 THEN stddev_samp(step) {_AT.format(19, 'CURRENT ROW')} * sqrt(52.0) END AS rv FROM inp),
    cells AS (SELECT series_id, day, unnest([{', '.join(f"'{c}'" for c in _USED)}]) AS c, unnest([{', '.join(_USED)}]) AS x FROM fac)"""
_HALF = "(2e0 ** (-1e0 / 104))"
STATES_SQL = f"""{RAW_FACTORS_SQL}, rob AS (SELECT series_id, day, c, CASE WHEN count(x) OVER w = 52 THEN (x - quantile_cont(x, 0.5) OVER w) / (1.4826 * mad(x) OVER w + 1e-12) END AS z FROM cells WINDOW w AS (PARTITION BY series_id, c ORDER BY day ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING)),
    known AS (SELECT *, row_number() OVER (PARTITION BY series_id, c ORDER BY day) AS i FROM cells WHERE x IS NOT NULL),
    ew AS (SELECT series_id, day, c, i, x AS m, 0e0 AS v, CAST(NULL AS DOUBLE) AS z FROM known WHERE i = 1 UNION ALL SELECT k.series_id, k.day, k.c, k.i, {_HALF} * ew.m + (1 - {_HALF}) * k.x, {_HALF} * ew.v + (1 - {_HALF}) * (k.x - ew.m) ** 2,
      (k.x - ({_HALF} * ew.m + (1 - {_HALF}) * k.x)) / sqrt({_HALF} * ew.v + (1 - {_HALF}) * (k.x - ew.m) ** 2 + 1e-12) FROM ew JOIN known k ON k.series_id = ew.series_id AND k.c = ew.c AND k.i = ew.i + 1),
    dual AS (SELECT series_id, day, c, 0.5 * rob.z + 0.5 * CASE WHEN ew.i > 26 THEN ew.z END AS d FROM rob LEFT JOIN ew USING (series_id, day, c)),
    wide_ AS (SELECT series_id, day, {', '.join(f"max(d) FILTER (c = '{c}') AS {c}" for c in _USED)} FROM dual GROUP BY 1, 2),
    mixed AS (SELECT series_id, day, -0.25 * (tilt + move + wide + open_share) AS liquidity, 0.5 * (u_short + u_long) AS heat, (u_trend - spread - rv) / 3 AS taste FROM wide_),
    states AS (SELECT *, 0.40 * liquidity + 0.35 * heat + 0.25 * taste AS h, 0.50 * (liquidity - lag(liquidity, 4) OVER w) + 0.30 * (heat - lag(heat, 4) OVER w) + 0.20 * (taste - lag(taste, 4) OVER w) AS i FROM mixed WINDOW w AS (PARTITION BY series_id ORDER BY day))"""


_FACTORS = ("liquidity", "heat", "taste", "h", "i")


@query("state_factors", f"WITH RECURSIVE {STATES_SQL} SELECT series_id, day, " + ", ".join(f"round(CASE WHEN {c} IS NOT NULL THEN greatest(-1e6, least(1e6, {c})) END, 6) + 0.0 AS {c}" for c in _FACTORS) + " FROM states")
def state_factors(spark, sf_dir):
    out = state.state(chain_inputs(spark, sf_dir), "series_id", "day", "price", ["tilt", "lines", "wide", "open_share"], "spread", SHORT)
    # A flat window has no spread, so its scores are of the order of 1 / EPS: cut for the comparison.
    cut = lambda c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(-1e6), F.least(F.lit(1e6), F.col(c))))
    return out.select("series_id", "day", *[neat(cut(c)).alias(c) for c in _FACTORS])


DRIFT_SQL = f"""{RAW_FACTORS_SQL}, held AS (SELECT *, list(x) FILTER (x IS NOT NULL) OVER (PARTITION BY series_id, c ORDER BY day ROWS BETWEEN 155 PRECEDING AND CURRENT ROW) AS w FROM cells),
    share AS (SELECT series_id, day, c, CASE WHEN x IS NOT NULL THEN CAST(len(list_filter(w, lambda v: v <= x)) AS DOUBLE) / len(w) END AS s FROM held), sh AS (SELECT series_id, day, {', '.join(f"max(s) FILTER (c = '{c}') AS {c}" for c in _USED)} FROM share GROUP BY 1, 2),
    lev AS (SELECT series_id, day, 0.40e0 * -0.25e0 * (tilt + move + wide + open_share) + 0.35e0 * 0.5e0 * (u_short + u_long) + 0.25e0 * (u_trend - spread - rv) / 3 AS level FROM sh),
    kl AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY day) AS i FROM lev WHERE level IS NOT NULL),
    sl AS (SELECT series_id, day, i, level AS slow FROM kl WHERE i = 1 UNION ALL SELECT k.series_id, k.day, k.i, {_HALF} * sl.slow + (1 - {_HALF}) * k.level FROM sl JOIN kl k ON k.series_id = sl.series_id AND k.i = sl.i + 1),
    al AS (SELECT l.series_id, l.day, last_value(slow IGNORE NULLS) OVER (PARTITION BY l.series_id ORDER BY l.day) AS slow, quantile_cont(level, 0.5) OVER w AS med, 1.4826 * mad(level) OVER w AS sc FROM lev l LEFT JOIN sl USING (series_id, day) WINDOW w AS (PARTITION BY l.series_id ORDER BY l.day ROWS BETWEEN 155 PRECEDING AND CURRENT ROW)),
    drift AS (SELECT series_id, day, (slow - med) / (sc + 1e-12) AS drift FROM al)"""


@query("drift_probe", f"WITH RECURSIVE {DRIFT_SQL} SELECT series_id, day, round(drift, 6) + 0.0 AS drift, CAST(coalesce(abs(drift) >= 1.8, false) AS INTEGER) AS drift_flag FROM drift")
def drift_probe(spark, sf_dir):
    out = state.drift(chain_inputs(spark, sf_dir), "series_id", "day", "price", ["tilt", "lines", "wide", "open_share"], "spread", SHORT)
    return out.withColumn("drift", neat("drift"))


@query("pipeline_full")
def pipeline_full(spark, sf_dir):
    return state.decision_records(chain_inputs(spark, sf_dir), "series_id", "day", "price", ["tilt", "lines", "wide", "open_share"], "spread", "wide", "open_share", SHORT)


COV_SQL = f"""{DAYS_SQL}, s AS (SELECT series_id, day, price / 100000 AS x, ln(1 + n_orders + price / 300000) AS y, row_number() OVER (PARTITION BY series_id ORDER BY day) AS i FROM days),
    z AS (SELECT series_id, avg(x) AS mx, avg(y) AS my, var_samp(x) + 1e-8 AS a, covar_samp(x, y) AS b, var_samp(y) + 1e-8 AS c FROM s WHERE i <= 20 GROUP BY 1),
    f AS (SELECT series_id, DATE '1900-01-01' AS day, CAST(0 AS BIGINT) AS i, mx, my, a, b, c, 0.0::DOUBLE AS dist FROM z UNION ALL
      SELECT series_id, day, i, r * mx + (1 - r) * x, r * my + (1 - r) * y, r * a + (1 - r) * w * w * dx * dx, r * b + (1 - r) * w * w * dx * dy, r * c + (1 - r) * w * w * dy * dy, dist FROM (
        SELECT *, least(1.0, 2.5 / greatest(dist, 1e-12)) AS w FROM (
          SELECT s.series_id, s.day, s.i, s.x, s.y, f.mx, f.my, f.a, f.b, f.c, s.x - f.mx AS dx, s.y - f.my AS dy, 2 ** (-1.0 / 78) AS r,
            sqrt((f.c * (s.x - f.mx) ** 2 - 2 * f.b * (s.x - f.mx) * (s.y - f.my) + f.a * (s.y - f.my) ** 2) / (f.a * f.c - f.b * f.b)) AS dist FROM f JOIN s ON s.series_id = f.series_id AND s.i = f.i + 1)))"""


def covariance_rows(spark, sf_dir):
    """The covariance of price and activity, seeded by each series' first 20 steps."""
    base = days(spark, sf_dir).select("series_id", "day", (F.col("price") / 100000).alias("x"), F.log(1 + F.col("n_orders") + F.col("price") / 300000).alias("y"))

    class Seeded:
        def __init__(self):
            self.first, self.rows = True, []

        def step(self, x, y, seed):
            if self.first:
                self.cov, self.first = rec.Covariance2D([(p["x"], p["y"]) for p in seed]), False
            made = self.cov.step(x, y)
            return *made[:5], made[7]

    ahead = Window.partitionBy("series_id").orderBy("day").rowsBetween(0, 19)
    by = Window.partitionBy("series_id").orderBy("day")
    seeded = base.withColumn("seed", F.when(F.row_number().over(by) == 1, F.collect_list(F.struct("x", "y")).over(ahead)))
    return run_fold(seeded, "series_id", "day", Seeded, ["x", "y", "seed"], "mean_x double, mean_y double, var_x double, cov_xy double, var_y double, distance double")


@query("cov2d_state", f"WITH RECURSIVE {COV_SQL} SELECT series_id, day, round(mx, 6) + 0.0 AS mean_x, round(my, 6) + 0.0 AS mean_y, round(a, 6) + 0.0 AS var_x, round(b, 6) + 0.0 AS cov_xy, round(c, 6) + 0.0 AS var_y, round(dist, 5) + 0.0 AS distance FROM f WHERE i > 0")
def cov2d_state(spark, sf_dir):
    out = covariance_rows(spark, sf_dir)
    return out.select("series_id", "day", *[neat(c).alias(c) for c in ("mean_x", "mean_y", "var_x", "cov_xy", "var_y")], neat("distance", 5).alias("distance"))
