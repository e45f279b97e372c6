"""Weekly cycle snapshots: eligibility, required week, alerts, status and revisions.

A snapshot is one published run for a week: mode, backfill_mode, the signal values
(h_t, rho_t, s_t, k_hat, p_t), drift_flag, flags of its gates and the freshness of
its sources.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoplane.operators.audit import is_material

#: How levels rank, fixed values.
LEVELS = {"ok": 0, "warn": 1, "degrade": 2, "block": 3}
#: Section of the run book for each code, fixed values; others are in the first.
SECTIONS = {
    "missing_required_snapshot": "§2.1",
    "late_snapshot_publication": "§2.2",
    "stale_source_warn": "§2.3",
    "stale_source_degrade": "§2.3",
    "stale_source_block": "§2.3",
    "execution_degraded": "§3.1",
    "execution_blocked": "§3.2",
    "signal_invalid": "§3.3",
    "material_revision_latest_week": "§4.1",
}
CATEGORIES = ("signal_validity", "execution_readiness", "data_health")


def _lookup(key: Column, table: dict[str, object], default: object) -> Column:
    out = reduce(lambda acc, kv: acc.when(key == kv[0], F.lit(kv[1])), list(table.items())[1:], F.when(key == next(iter(table)), F.lit(next(iter(table.values())))))
    return out.otherwise(F.lit(default))


def level_rank(c: Column) -> Column:
    return _lookup(c, LEVELS, 0)


def available(c: str) -> Column:
    """A number that is known and finite."""
    return F.col(c).isNotNull() & (F.abs(F.col(c).cast("double")) < float("inf")) & ~F.isnan(F.col(c).cast("double"))


def signal_eligibility(snapshots: DataFrame, paper_only: bool = True, submission_allowed: bool = False) -> DataFrame:
    """Add reason, signal_eligible and which values are there; the first rule that fails names the reason."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    backfill = F.coalesce("backfill_mode", F.lit(""))
    rules = [
        (F.lit(not paper_only or submission_allowed), "paper_only_invariant_failed"),
        (backfill == "degraded_backfill", "degraded_backfill_signal"),
        (backfill == "block", "block_signal"),
        (F.coalesce("mode", F.lit("")) != "strict", "not_strict_mode"),
        (~yes("execution_permitted"), "execution_not_permitted"),
        (~yes("strict_gate_passed"), "strict_gate_failed"),
        (~available("h_t"), "h_t_missing"),
        (~available("rho_t"), "rho_t_missing"),
        (~available("k_hat"), "k_hat_t_missing"),
        (~available("s_t"), "s_t_missing"),
        (F.col("backfill_mode").isNotNull() & (backfill != "strict_recovery"), "not_strict_mode"),
    ]
    reason = reduce(lambda acc, r: acc.when(*r), rules[1:], F.when(*rules[0])).otherwise("eligible_strict_signal")
    out = snapshots.withColumn("reason", reason).withColumn("signal_eligible", F.col("reason") == "eligible_strict_signal")
    return out.withColumns({f"{c}_available": available(c) for c in ("h_t", "rho_t", "k_hat", "s_t")})


def local_cutoff(week_end: Column, days: int = 1, hours: int = 12) -> Column:
    """The local time by which a week must be published."""
    return week_end.cast("timestamp_ntz") + F.make_dt_interval(F.lit(days), F.lit(hours))


def required_week(now: Column) -> Column:
    """The latest week, ending on Friday, whose cutoff has passed at a local time."""
    friday = F.date_sub(now.cast("date"), F.pmod(F.dayofweek(now) - 6, F.lit(7)))
    return F.when(now >= local_cutoff(friday), friday).otherwise(F.date_sub(friday, 7))


def latest_view(snapshots: DataFrame, keys: list[str]) -> DataFrame:
    """The run published last for each key, all columns."""
    rest = [c for c in snapshots.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct("published_at", "run_id")).alias("_s")
    return snapshots.groupBy(*keys).agg(newest).select(*keys, "_s.*")


def revision_audit(snapshots: DataFrame, keys: list[str]) -> DataFrame:
    """Per key its first against its latest run: what changed, by how much, and whether it matters."""
    facts = F.struct("published_at", "mode", "k_hat", "p_t", "s_t", "h_t", "rho_t", "drift_flag")
    order = F.struct("published_at", "run_id")
    both = snapshots.groupBy(*keys).agg(F.count(F.lit(1)).alias("run_count"), F.min_by(facts, order).alias("a"), F.max_by(facts, order).alias("b"))
    delta = {c: F.col(f"b.{c}_t") - F.col(f"a.{c}_t") for c in ("s", "h", "rho")}
    steps = F.zip_with("a.p_t", "b.p_t", lambda x, y: F.abs(x - y))
    largest = F.when(F.size("a.p_t") == F.size("b.p_t"), F.array_max(steps))
    p_same = (F.col("a.p_t").isNull() & F.col("b.p_t").isNull()) | F.coalesce(largest <= 1e-12, F.lit(False))
    out = both.select(
        *keys, "run_count", F.col("a.published_at").alias("first_published_at"), F.col("b.published_at").alias("latest_published_at"),
        F.col("a.mode").alias("initial_mode"), F.col("b.mode").alias("latest_mode"), F.col("a.k_hat").alias("initial_k_hat"), F.col("b.k_hat").alias("latest_k_hat"),
        *[d.alias(f"delta_{c}") for c, d in delta.items()], largest.alias("max_abs_p_delta"), (~p_same).alias("p_t_changed"),
        (~F.col("a.drift_flag").eqNullSafe(F.col("b.drift_flag"))).alias("drift_flag_changed"),
    )
    moved = lambda c: is_material(F.col(f"delta_{c}"))
    mode, k = ~F.col("initial_mode").eqNullSafe(F.col("latest_mode")), ~F.col("initial_k_hat").eqNullSafe(F.col("latest_k_hat"))
    reasons = [(mode, "mode_changed"), (k, "k_hat_t_changed")] + [(moved(c), f"delta_{c}_gt_0.05") for c in ("s", "h", "rho")] + [(F.col("p_t_changed"), "p_t_changed"), (F.col("drift_flag_changed"), "drift_flag_changed")]
    out = out.withColumn("revision_reason", F.concat_ws(";", *[F.when(c, F.lit(name)) for c, name in reasons]))
    return out.withColumn("material_revision", mode | k | moved("s") | moved("h") | moved("rho"))


def revision_totals(detail: DataFrame) -> DataFrame:
    """One row: counts of weeks by what changed, the largest changes, and the checks of the audit."""
    changed = lambda a, b: F.count_if(~F.col(a).eqNullSafe(F.col(b)))
    most = lambda c: F.coalesce(F.max(F.abs(c)), F.lit(0.0))
    return detail.agg(
        F.count(F.lit(1)).alias("weeks_total"), F.count_if(F.col("run_count") > 1).alias("weeks_with_multiple_runs"), F.count_if("material_revision").alias("material_revision_weeks"),
        changed("initial_mode", "latest_mode").alias("mode_changed_weeks"), changed("initial_k_hat", "latest_k_hat").alias("k_hat_changed_weeks"),
        F.count_if("p_t_changed").alias("p_t_changed_weeks"), F.count_if("drift_flag_changed").alias("drift_flag_changed_weeks"),
        most("delta_s").alias("max_abs_delta_s"), most("delta_h").alias("max_abs_delta_h"), most("delta_rho").alias("max_abs_delta_rho"),
        F.coalesce(F.bool_and(F.col("first_published_at") <= F.col("latest_published_at")), F.lit(False)).alias("earliest_latest_selection_works"),
        F.coalesce(F.bool_or(F.col("run_count") > 1), F.lit(False)).alias("same_week_multiple_runs_supported"),
    )


def _at_required_week(checks: DataFrame, snapshots: DataFrame, key: str) -> DataFrame:
    """Each check (key, now) with the latest run of its required week, its audit and the latest week."""
    latest = latest_view(snapshots, [key, "week_end"])
    audit = revision_audit(snapshots, [key, "week_end"]).select(key, F.col("week_end").alias("required_week_end"), "material_revision")
    asked = checks.withColumn("required_week_end", required_week(F.col("now")))
    held = latest.withColumnRenamed("week_end", "required_week_end").withColumn("_found", F.lit(True))
    weeks = latest.groupBy(key).agg(F.max("week_end").alias("latest_week_end"))
    return asked.join(held, [key, "required_week_end"], "left").join(audit, [key, "required_week_end"], "left").join(weeks, key, "left")


def weekly_alerts(checks: DataFrame, snapshots: DataFrame, key: str) -> DataFrame:
    """A row per alert of each check: what is wrong with the week due then, worst first."""
    at = _at_required_week(checks, snapshots, key)
    found = F.col("_found").isNotNull()

    def alert(condition: Column, category: str, level: Column, code: Column, place: int = 0) -> Column:
        return F.when(F.coalesce(condition, F.lit(False)), F.struct(F.lit(category).alias("category"), level.alias("level"), code.alias("code"), F.lit(place).alias("source_place")))

    def fixed(condition: Column, category: str, level: str, code: str) -> Column:
        return alert(condition, category, F.lit(level), F.lit(code))

    single = F.array(
        fixed(~found, "data_health", "block", "missing_required_snapshot"),
        fixed(found & (F.col("published_at") > local_cutoff(F.col("required_week_end"))), "data_health", "warn", "late_snapshot_publication"),
        fixed(found & (F.col("k_hat").isNull() | F.col("p_t").isNull() | F.col("s_t").isNull()), "signal_validity", "block", "signal_invalid"),
        fixed(F.col("execution_state") == "degrade", "execution_readiness", "degrade", "execution_degraded"),
        fixed(F.col("execution_state") == "block", "execution_readiness", "block", "execution_blocked"),
        fixed(F.col("material_revision") & found, "signal_validity", "warn", "material_revision_latest_week"),
    )
    level = lambda x: F.when(x["level"].isin("warn", "degrade", "block"), x["level"]).otherwise("warn")
    stale = F.transform(
        F.coalesce("freshness", F.array().cast("array<struct<source:string,fresh:boolean,level:string>>")),
        lambda x, i: F.when(~F.coalesce(x["fresh"], F.lit(False)), F.struct(F.lit("data_health").alias("category"), level(x).alias("level"), F.concat(F.lit("stale_source_"), level(x)).alias("code"), (i + 1).alias("source_place"))),
    )
    alerts = at.withColumn("a", F.explode(F.filter(F.concat(single, stale), lambda x: x.isNotNull())))
    week = F.when(F.col("a.code") == "missing_required_snapshot", F.col("latest_week_end")).otherwise(F.col("required_week_end"))
    rows = alerts.select(key, "now", "required_week_end", week.alias("snapshot_week_end"), "a.*").withColumn("section", _lookup(F.col("code"), SECTIONS, "§1.1"))
    order = Window.partitionBy(key, "now").orderBy(level_rank(F.col("level")).desc(), "category", "code", "source_place")
    return rows.withColumn("place", F.row_number().over(order))


def cycle_status(checks: DataFrame, snapshots: DataFrame, key: str) -> DataFrame:
    """Per check the worst level of each category and of all, sections to read, and source counts."""
    rank_name = F.array(*[F.lit(x) for x in LEVELS])
    worst = lambda c: F.get(rank_name, F.coalesce(F.max(F.when(c, level_rank(F.col("level")))), F.lit(0)))
    alerts = weekly_alerts(checks, snapshots, key).groupBy(key, "now").agg(
        *[worst(F.col("category") == c).alias(c) for c in CATEGORIES], F.upper(worst(F.lit(True))).alias("current_status"),
        F.array_join(F.array_sort(F.collect_set("section")), ",").alias("sections"), F.count(F.lit(1)).alias("n_alerts"),
    )
    at = _at_required_week(checks, snapshots, key)
    stale = F.size(F.filter("freshness", lambda x: ~F.coalesce(x["fresh"], F.lit(False))))
    facts = at.select(key, "now", "required_week_end", F.when(F.col("_found").isNotNull(), F.col("published_at") <= local_cutoff(F.col("required_week_end"))).alias("published_by_sla"),
                      F.coalesce(stale, F.lit(0)).alias("stale_source_count"), F.coalesce(F.size("freshness") - stale, F.lit(0)).alias("fresh_source_count"))
    out = facts.join(alerts, [key, "now"], "left")
    return out.na.fill("ok", list(CATEGORIES)).na.fill({"current_status": "OK", "sections": "§1.1", "n_alerts": 0})


def mode_coverage(snapshots: DataFrame, key: str) -> DataFrame:
    """Per key: rows and first week by mode, and the span of strict weeks."""
    first = lambda m: F.min(F.when(F.col("mode") == m, F.col("week_end")))
    return snapshots.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("mode") == "strict").alias("n_strict"), F.count_if(F.col("mode") == "degraded").alias("n_degraded"), F.count_if(F.col("mode") == "warmup").alias("n_warmup"),
        first("strict").alias("first_strict"), F.max(F.when(F.col("mode") == "strict", F.col("week_end"))).alias("last_strict"), F.min(F.when(F.col("mode") != "warmup", F.col("week_end"))).alias("first_warm"),
    )


def resolve_route(proof_strict: Column, verdict: Column) -> tuple[Column, Column]:
    """(scheme, reason) of a controlled backfill from its proof and its validation."""
    passed = verdict.isin("validation_passed_strict", "validation_passed_degraded_only")
    scheme = F.when(~passed, "block").when(proof_strict & (verdict == "validation_passed_strict"), "strict_recovery").otherwise("degraded_backfill")
    reason = F.when(~passed, verdict).when(scheme == "strict_recovery", "strict_evidence_and_validation").when(~proof_strict, "publication_not_proven").otherwise("validation_degraded_only")
    return scheme, reason
