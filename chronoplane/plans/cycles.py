"""Queries on weekly cycle snapshots; an order stands for a run of its priority's week."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoplane.operators import cycles
from chronoplane.operators.timeaxis import week_end
from chronoplane.plans.inputs import FRIDAY
from chronoplane.plans.registry import neat, query, table


def snapshots(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    friday = week_end(F.to_date("o_orderdate"))
    share = lambda x: (x % 100) / F.lit(100.0)
    source = lambda name, i: F.struct(F.lit(name).alias("source"), (k % (i + 3) != 0).alias("fresh"), F.get(F.array(F.lit("warn"), F.lit("degrade"), F.lit("block")), ((c + i) % 3).cast("int")).alias("level"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("book"), friday.alias("week_end"), k.alias("run_id"), (friday.cast("timestamp_ntz") + F.make_dt_interval(hours=(k % 60).cast("int"))).alias("published_at"),
        F.when(k % 10 == 0, "warmup").when(k % 10 == 1, "degraded").otherwise("strict").alias("mode"),
        F.when(k % 9 == 0, "degraded_backfill").when(k % 9 == 1, "block").when(k % 9 == 2, "strict_recovery").when(k % 9 == 3, "other").alias("backfill_mode"),
        (k % 6 != 0).alias("execution_permitted"), (c % 8 != 0).alias("strict_gate_passed"),
        F.when(c % 11 != 0, share(c)).alias("h_t"), F.when(c % 12 != 0, share(k)).alias("rho_t"), F.when(k % 13 != 0, share(k + c)).alias("s_t"), F.when(c % 14 != 0, (c % 5).cast("int")).alias("k_hat"),
        F.when(k % 15 != 0, F.array(*[F.when(k % 5 == i, 0.6).otherwise(0.1) for i in range(5)])).alias("p_t"), (k % 16 == 0).cast("int").alias("drift_flag"),
        F.when(k % 5 == 0, "degrade").when(k % 5 == 1, "block").otherwise("execute").alias("execution_state"), F.array(source("macro", 0), source("prices", 1), source("weights", 2)).alias("freshness"),
    )


_SOURCE = "{{'source': '{0}', 'fresh': k % {2} <> 0, 'level': CASE (c + {1}) % 3 WHEN 0 THEN 'warn' WHEN 1 THEN 'degrade' ELSE 'block' END}}"
SNAPS_SQL = f"""o AS (SELECT *, o_orderkey AS k, o_custkey AS c, {FRIDAY.format('CAST(o_orderdate AS DATE)')} AS f FROM orders),
    snaps AS (SELECT o_orderpriority AS book, f AS week_end, k AS run_id, CAST(f AS TIMESTAMP) + to_hours(CAST(k % 60 AS INTEGER)) AS published_at, CASE k % 10 WHEN 0 THEN 'warmup' WHEN 1 THEN 'degraded' ELSE 'strict' END AS mode,
      CASE k % 9 WHEN 0 THEN 'degraded_backfill' WHEN 1 THEN 'block' WHEN 2 THEN 'strict_recovery' WHEN 3 THEN 'other' END AS backfill_mode, k % 6 <> 0 AS execution_permitted, c % 8 <> 0 AS strict_gate_passed,
      CASE WHEN c % 11 <> 0 THEN (c % 100) / 100e0 END AS h_t, CASE WHEN c % 12 <> 0 THEN (k % 100) / 100e0 END AS rho_t, CASE WHEN k % 13 <> 0 THEN ((k + c) % 100) / 100e0 END AS s_t, CASE WHEN c % 14 <> 0 THEN CAST(c % 5 AS INTEGER) END AS k_hat,
      CASE WHEN k % 15 <> 0 THEN [{', '.join(f'CASE WHEN k % 5 = {i} THEN 0.6e0 ELSE 0.1e0 END' for i in range(5))}] END AS p_t, CAST(k % 16 = 0 AS INTEGER) AS drift_flag,
      CASE k % 5 WHEN 0 THEN 'degrade' WHEN 1 THEN 'block' ELSE 'execute' END AS execution_state, [{', '.join(_SOURCE.format(n, i, i + 3) for i, n in enumerate(('macro', 'prices', 'weights')))}] AS freshness FROM o)"""
_LATEST = "latest AS (SELECT * FROM snaps QUALIFY row_number() OVER (PARTITION BY book, week_end ORDER BY published_at DESC, run_id DESC) = 1)"
_AUDIT = """ends AS (SELECT book, week_end, count(*) AS run_count, arg_min(s, (s.published_at, s.run_id)) AS a, arg_max(s, (s.published_at, s.run_id)) AS b FROM (SELECT book, week_end, snaps AS s FROM snaps) GROUP BY 1, 2),
    moves AS (SELECT book, week_end, run_count, a.published_at AS first_published_at, b.published_at AS latest_published_at, a.mode AS initial_mode, b.mode AS latest_mode, a.k_hat AS initial_k_hat, b.k_hat AS latest_k_hat,
      b.s_t - a.s_t AS delta_s, b.h_t - a.h_t AS delta_h, b.rho_t - a.rho_t AS delta_rho, CASE WHEN a.p_t IS NOT NULL AND b.p_t IS NOT NULL THEN list_max(list_transform(list_zip(a.p_t, b.p_t), lambda x: abs(x[1] - x[2]))) END AS max_abs_p_delta,
      a.p_t IS NULL AS an, b.p_t IS NULL AS bn, a.drift_flag IS DISTINCT FROM b.drift_flag AS drift_flag_changed FROM ends),
    flags AS (SELECT *, NOT ((an AND bn) OR coalesce(max_abs_p_delta <= 1e-12, false)) AS p_t_changed, initial_mode IS DISTINCT FROM latest_mode AS m, initial_k_hat IS DISTINCT FROM latest_k_hat AS kk,
      coalesce(abs(delta_s) > 0.05e0 + 1e-12, false) AS ds, coalesce(abs(delta_h) > 0.05e0 + 1e-12, false) AS dh, coalesce(abs(delta_rho) > 0.05e0 + 1e-12, false) AS dr FROM moves),
    audit AS (SELECT *, concat_ws(';', CASE WHEN m THEN 'mode_changed' END, CASE WHEN kk THEN 'k_hat_t_changed' END, CASE WHEN ds THEN 'delta_s_gt_0.05' END, CASE WHEN dh THEN 'delta_h_gt_0.05' END, CASE WHEN dr THEN 'delta_rho_gt_0.05' END,
      CASE WHEN p_t_changed THEN 'p_t_changed' END, CASE WHEN drift_flag_changed THEN 'drift_flag_changed' END) AS revision_reason, m OR kk OR ds OR dh OR dr AS material_revision FROM flags)"""
#: Every week's check is at a local time of its own, around the week's cutoff.
_CHECKS = """checks AS (SELECT DISTINCT book, CAST(week_end AS TIMESTAMP) + to_hours(CAST(dayofyear(week_end) * 7 % 60 AS INTEGER)) AS now FROM snaps),
    due AS (SELECT *, CASE WHEN now >= CAST(f AS TIMESTAMP) + INTERVAL 36 HOUR THEN f ELSE f - 7 END AS required_week_end FROM (SELECT *, CAST(now AS DATE) - CAST((dayofweek(now) + 2) % 7 AS INTEGER) AS f FROM checks)),
    atw AS (SELECT d.book, d.now, d.required_week_end, l.run_id IS NOT NULL AS found, l.* EXCLUDE (book, week_end), a.material_revision, (SELECT max(week_end) FROM latest x WHERE x.book = d.book) AS latest_week_end
      FROM due d LEFT JOIN latest l ON l.book = d.book AND l.week_end = d.required_week_end LEFT JOIN audit a ON a.book = d.book AND a.week_end = d.required_week_end)"""
_LEVEL = "CASE {0} WHEN 'warn' THEN 1 WHEN 'degrade' THEN 2 WHEN 'block' THEN 3 ELSE 0 END"
_FIRED = f"""fired AS (SELECT book, now, required_week_end, latest_week_end AS snapshot_week_end, 'data_health' AS category, 'block' AS level, 'missing_required_snapshot' AS code, 0 AS source_place FROM atw WHERE NOT found
    UNION ALL SELECT book, now, required_week_end, required_week_end, 'data_health', 'warn', 'late_snapshot_publication', 0 FROM atw WHERE found AND published_at > CAST(required_week_end AS TIMESTAMP) + INTERVAL 36 HOUR
    UNION ALL SELECT book, now, required_week_end, required_week_end, 'signal_validity', 'block', 'signal_invalid', 0 FROM atw WHERE found AND (k_hat IS NULL OR p_t IS NULL OR s_t IS NULL)
    UNION ALL SELECT book, now, required_week_end, required_week_end, 'execution_readiness', 'degrade', 'execution_degraded', 0 FROM atw WHERE execution_state = 'degrade'
    UNION ALL SELECT book, now, required_week_end, required_week_end, 'execution_readiness', 'block', 'execution_blocked', 0 FROM atw WHERE execution_state = 'block'
    UNION ALL SELECT book, now, required_week_end, required_week_end, 'signal_validity', 'warn', 'material_revision_latest_week', 0 FROM atw WHERE found AND material_revision
    UNION ALL SELECT book, now, required_week_end, required_week_end, 'data_health', x.level, 'stale_source_' || x.level, i FROM (SELECT *, unnest(freshness) AS x, generate_subscripts(freshness, 1) AS i FROM atw) WHERE NOT x.fresh),
    alerts AS (SELECT *, CASE {' '.join(f"WHEN code = '{c}' THEN '{s}'" for c, s in cycles.SECTIONS.items())} ELSE '§1.1' END AS section,
      CAST(row_number() OVER (PARTITION BY book, now ORDER BY {_LEVEL.format('level')} DESC, category, code, source_place) AS INTEGER) AS place FROM fired)"""


def _checks(spark, sf_dir):
    now = F.col("week_end").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.dayofyear("week_end") * 7 % 60).cast("int"))
    return snapshots(spark, sf_dir).select("book", now.alias("now")).distinct()


_HAS = {c: f"{c} IS NOT NULL AS {c}_available" for c in ("h_t", "rho_t", "k_hat", "s_t")}


@query(
    "signal_gate",
    f"""WITH {SNAPS_SQL}, r AS (SELECT *, CASE WHEN backfill_mode = 'degraded_backfill' THEN 'degraded_backfill_signal' WHEN backfill_mode = 'block' THEN 'block_signal' WHEN mode <> 'strict' THEN 'not_strict_mode' WHEN NOT execution_permitted THEN 'execution_not_permitted'
    WHEN NOT strict_gate_passed THEN 'strict_gate_failed' WHEN h_t IS NULL THEN 'h_t_missing' WHEN rho_t IS NULL THEN 'rho_t_missing' WHEN k_hat IS NULL THEN 'k_hat_t_missing' WHEN s_t IS NULL THEN 's_t_missing' WHEN backfill_mode = 'other' THEN 'not_strict_mode'
    ELSE 'eligible_strict_signal' END AS reason FROM snaps) SELECT run_id, reason, reason = 'eligible_strict_signal' AS signal_eligible, {', '.join(_HAS.values())} FROM r""",
)
def signal_gate(spark, sf_dir):
    return cycles.signal_eligibility(snapshots(spark, sf_dir)).select("run_id", "reason", "signal_eligible", *[f"{c}_available" for c in _HAS])


_DETAIL = "run_count, first_published_at, latest_published_at, initial_mode, latest_mode, initial_k_hat, latest_k_hat, {0}, p_t_changed, drift_flag_changed, revision_reason, material_revision"
_DELTAS = ("delta_s", "delta_h", "delta_rho", "max_abs_p_delta")


@query("revision_detail", f"WITH {SNAPS_SQL}, {_AUDIT} SELECT book, week_end, " + _DETAIL.format(", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in _DELTAS)) + " FROM audit")
def revision_detail(spark, sf_dir):
    return cycles.revision_audit(snapshots(spark, sf_dir), ["book", "week_end"]).withColumns({c: neat(c) for c in _DELTAS})


@query(
    "revision_summary",
    f"""WITH {SNAPS_SQL}, {_AUDIT} SELECT count(*) AS weeks_total, count(*) FILTER (run_count > 1) AS weeks_with_multiple_runs, count(*) FILTER (material_revision) AS material_revision_weeks, count(*) FILTER (m) AS mode_changed_weeks, count(*) FILTER (kk) AS k_hat_changed_weeks,
    count(*) FILTER (p_t_changed) AS p_t_changed_weeks, count(*) FILTER (drift_flag_changed) AS drift_flag_changed_weeks, {', '.join(f'round(coalesce(max(abs(delta_{c})), 0), 6) + 0.0 AS max_abs_delta_{c}' for c in ('s', 'h', 'rho'))},
    bool_and(first_published_at <= latest_published_at) AS earliest_latest_selection_works, bool_or(run_count > 1) AS same_week_multiple_runs_supported FROM audit""",
)
def revision_summary(spark, sf_dir):
    out = cycles.revision_totals(cycles.revision_audit(snapshots(spark, sf_dir), ["book", "week_end"]))
    return out.withColumns({f"max_abs_delta_{c}": neat(f"max_abs_delta_{c}") for c in ("s", "h", "rho")})


@query("required_week", f"WITH {SNAPS_SQL}, {_LATEST}, {_AUDIT}, {_CHECKS} SELECT book, now, required_week_end FROM due")
def required_week(spark, sf_dir):
    return _checks(spark, sf_dir).withColumn("required_week_end", cycles.required_week(F.col("now")))


@query("alert_log", f"WITH {SNAPS_SQL}, {_LATEST}, {_AUDIT}, {_CHECKS}, {_FIRED} SELECT * EXCLUDE (source_place) FROM alerts")
def alert_log(spark, sf_dir):
    return cycles.weekly_alerts(_checks(spark, sf_dir), snapshots(spark, sf_dir), "book").drop("source_place")


_WORST = "['ok', 'warn', 'degrade', 'block'][1 + coalesce(max(CASE WHEN {0} THEN " + _LEVEL.format("level") + " END), 0)]"


@query(
    "ops_status",
    f"""WITH {SNAPS_SQL}, {_LATEST}, {_AUDIT}, {_CHECKS}, {_FIRED}, g AS (SELECT book, now, {', '.join(_WORST.format(f"category = '{c}'") + f' AS {c}' for c in cycles.CATEGORIES)}, upper({_WORST.format('true')}) AS current_status,
      string_agg(DISTINCT section, ',' ORDER BY section) AS sections, count(*) AS n_alerts FROM alerts GROUP BY 1, 2),
    s AS (SELECT *, CASE WHEN found THEN published_at <= CAST(required_week_end AS TIMESTAMP) + INTERVAL 36 HOUR END AS published_by_sla, coalesce(len(list_filter(freshness, lambda x: NOT x.fresh)), 0) AS stale, coalesce(len(freshness), 0) AS every_source FROM atw)
    SELECT book, now, required_week_end, published_by_sla, CAST(stale AS INTEGER) AS stale_source_count, CAST(every_source - stale AS INTEGER) AS fresh_source_count, {', '.join(f"coalesce({c}, 'ok') AS {c}" for c in cycles.CATEGORIES)},
    coalesce(current_status, 'OK') AS current_status, coalesce(sections, '§1.1') AS sections, coalesce(n_alerts, 0) AS n_alerts FROM s LEFT JOIN g USING (book, now)""",
)
def ops_status(spark, sf_dir):
    return cycles.cycle_status(_checks(spark, sf_dir), snapshots(spark, sf_dir), "book")


@query(
    "mode_coverage",
    f"""WITH {SNAPS_SQL}, {_LATEST} SELECT book, count(*) AS n_rows, count(*) FILTER (mode = 'strict') AS n_strict, count(*) FILTER (mode = 'degraded') AS n_degraded, count(*) FILTER (mode = 'warmup') AS n_warmup, min(week_end) FILTER (mode = 'strict') AS first_strict,
    max(week_end) FILTER (mode = 'strict') AS last_strict, min(week_end) FILTER (mode <> 'warmup') AS first_warm FROM latest GROUP BY 1""",
)
def mode_coverage(spark, sf_dir):
    return cycles.mode_coverage(cycles.latest_view(snapshots(spark, sf_dir), ["book", "week_end"]), "book")
