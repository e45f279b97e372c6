"""Hand-computed values, and properties that every point-in-time operator must have."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoplane.functions import canonical, scalars
from chronoplane.functions import recursions as rec
from chronoplane.operators import audit, cycles, holdings, micro, pit, policy, portfolio, risk, stats, timeaxis
from chronoplane.operators.folds import run_fold
from chronoplane.operators.rolling import Frames

D = dt.date


def test_week_end_is_the_friday_on_or_after(spark):
    df = spark.createDataFrame([(D(2024, 1, 5),), (D(2024, 1, 6),), (D(2024, 1, 4),)], "d date")
    assert [r[0] for r in df.select(timeaxis.week_end(F.col("d"))).collect()] == [D(2024, 1, 5), D(2024, 1, 12), D(2024, 1, 5)]


def test_asof_backward_never_looks_ahead(spark):
    t = dt.datetime
    known = spark.createDataFrame([("a", t(2024, 1, 5, 15, 59), 10.0), ("a", t(2024, 1, 5, 16, 1), 99.0), ("a", t(2024, 1, 12, 15, 30), 12.0)], "k string, ts timestamp, v double")
    asked = spark.createDataFrame([("a", t(2024, 1, 5, 16, 0)), ("a", t(2024, 1, 12, 16, 0))], "k string, ts timestamp")
    out = pit.asof_backward(asked, known, "k", "ts", ["v"]).orderBy("ts").collect()
    assert [r.v for r in out] == [10.0, 12.0]


def test_adjusted_window_chains_factors(spark):
    prices = spark.createDataFrame([("x", D(2024, 1, 2), 100.0), ("x", D(2024, 1, 3), 51.0), ("x", D(2024, 1, 4), 50.0)], "k string, day date, p double")
    actions = spark.createDataFrame([("x", D(2024, 1, 3), 2.0), ("x", D(2024, 1, 4), 1.1)], "k string, day date, f double")
    (row,) = pit.adjusted_window(prices, actions, "k", "day", "p", "f", 3).collect()
    assert row.window == pytest.approx([220.0, 56.1, 50.0])


def test_fixed_rounds_the_binary_value(spark):
    values = [0.15, 0.125, 0.375, 2.5, 1e-9, 0.999999996, 53661.685168955, 37136.093671845, -1.5, 1e15 + 0.5, 12345.123456785, 3.0]
    for digits in (1, 2, 8):
        got = spark.createDataFrame([(v,) for v in values], "x double").select("x", scalars.fixed(F.col("x"), digits).alias("t")).collect()
        assert [r.t for r in got] == [f"{r.x:.{digits}f}" for r in got]
    assert spark.createDataFrame([(None,)], "x double").select(scalars.fixed(F.col("x"), 8)).first()[0] is None


def test_factors_do_not_depend_on_the_history(spark):
    """The factor of one action is the same after a thousand others."""
    old = [("x", D(2000, 1, 1) + dt.timedelta(i), [0.9, 0.91][i % 2]) for i in range(1000)]
    prices = spark.createDataFrame([("x", D(2024, 1, 2), 100.0), ("x", D(2024, 1, 3), 50.0)], "k string, day date, p double")
    run = lambda more: pit.adjusted_window(prices, spark.createDataFrame([*more, ("x", D(2024, 1, 3), 0.91)], "k string, day date, f double"), "k", "day", "p", "f", 2).first().window
    assert run(old) == run([])


def test_rename_sends_new_symbol_back(spark):
    asked = spark.createDataFrame([("NEW", D(2024, 1, 30)), ("NEW", D(2024, 2, 2))], "symbol string, day date")
    links = spark.createDataFrame([("OLD", "NEW", D(2024, 2, 1), D(2024, 1, 31), "pure_rename")], "old_symbol string, new_symbol string, effective_date date, known_at date, identity_type string")
    out = holdings.resolve_listing(asked, links, "symbol", "day", F.lit("2024-03-01").cast("date"))
    assert {r.day: (r.listed_as, r.status) for r in out.collect()} == {D(2024, 1, 30): ("OLD", "renamed"), D(2024, 2, 2): ("NEW", "unchanged")}
    early = holdings.resolve_listing(asked, links, "symbol", "day", F.lit("2024-01-30").cast("date"))
    assert {r.day: (r.listed_as, r.status) for r in early.collect()} == {D(2024, 1, 30): (None, "not_visible"), D(2024, 2, 2): ("NEW", "unchanged")}
    merged = holdings.resolve_listing(asked, links.withColumn("identity_type", F.lit("merger")), "symbol", "day", F.lit("2024-03-01").cast("date"))
    assert {r.status for r in merged.collect()} == {"not_bridgeable", "unchanged"}


def test_renames_of_one_day_have_an_order(spark):
    asked = spark.createDataFrame([("NEW", D(2024, 1, 30))], "symbol string, day date")
    links = [(old, "NEW", D(2024, 2, 1), D(2024, 1, 31), "pure_rename") for old in ("OLD8330", "OLD58730", "OLD14630", "OLD2030")]
    for rows in (links, links[::-1]):
        df = spark.createDataFrame(rows, "old_symbol string, new_symbol string, effective_date date, known_at date, identity_type string").coalesce(1)
        assert [r.listed_as for r in holdings.resolve_listing(asked, df, "symbol", "day", F.lit("2024-03-01").cast("date")).collect()] == ["OLD58730"]


def test_latest_vintage_flavours_differ(spark):
    facts = spark.createDataFrame([("x", 1, 10, 5.0), ("x", 1, 20, 6.0)], "k string, day int, known int, v double")
    asof = F.lit(15)
    assert pit.latest_visible(facts, ["k", "day"], "known", "v", asof).first().v == 5.0
    assert pit.latest_then_checked(facts, ["k", "day"], "known", "v", asof).isEmpty()


def test_percentile_rank_includes_the_current_row(spark):
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate([1, 2, 3, 2])], "k string, t int, x double")
    held = df.withColumn("w", F.collect_list("x").over(Frames("k", "t").last(3)))
    got = [r[0] for r in held.orderBy("t").select(F.size(F.filter("w", lambda v: v <= F.col("x"))) / F.size("w")).collect()]
    assert got == pytest.approx([1, 1, 1, 2 / 3])


def test_appending_the_future_leaves_the_past(spark):
    values = np.random.default_rng(1).normal(size=60).round(3).tolist()
    make = lambda n: spark.createDataFrame([("s", i, v) for i, v in enumerate(values[:n])], "k string, t int, x double")
    f = Frames("k", "t")
    past = make(40).select("t", f.robust_z(F.col("x"), 10).alias("z")).orderBy("t").collect()
    full = make(60).select("t", f.robust_z(F.col("x"), 10).alias("z")).orderBy("t").collect()
    assert past == full[:40]


def test_a_gap_blanks_gated_statistics(spark):
    df = spark.createDataFrame([("s", i, None if i == 5 else float(i)) for i in range(12)], "k string, t int, x double")
    got = [r[0] for r in df.select(Frames("k", "t").mean(F.col("x"), 3).alias("m"), "t").orderBy("t").collect()]
    assert [i for i, v in enumerate(got) if v is None] == [0, 1, 5, 6, 7]


def test_fold_does_not_depend_on_partitions(spark):
    rows = [(k, i, float((i * 7 + len(k)) % 11)) for k in ("a", "bb") for i in range(50)]
    df = spark.createDataFrame(rows, "k string, t int, x double")
    out = [sorted(run_fold(df.repartition(n), "k", "t", lambda: rec.EwZ(8), ["x"], "z double").collect()) for n in (1, 7)]
    assert out[0] == out[1]


def test_mean_holds_over_gaps_and_covariance_owes_decay():
    mean = rec.EwMean(10)
    assert [mean.step(x)[0] for x in (2.0, None)] == [2.0, 2.0]
    cov = rec.HuberCovariance([(0.0, 0.0), (1.0, 1.0)], half_life=10, bound=1e9)
    start, raw = cov.mean, cov.raw
    cov.update(None)
    cov.update(np.array([2.0, 3.0]))
    rho = 2 ** (-2 / 10)
    gap = np.array([2.0, 3.0]) - start
    assert cov.mean == pytest.approx(rho * start + (1 - rho) * np.array([2.0, 3.0]))
    assert cov.raw == pytest.approx(rho * raw + (1 - rho) * np.outer(gap, gap))
    assert cov.owed == 0


def test_lead_envelope_decays_heals_and_freezes():
    lead = rec.LeadEnvelope()
    assert [round(lead.step(h)[0], 6) for h in (0.9, 0.5)] == [0.9, 0.86]
    lead = rec.LeadEnvelope(start=0.72)
    assert lead.step(None)[0] == pytest.approx(0.698)
    lead = rec.LeadEnvelope(start=0.72)
    assert lead.step(0.1, frozen=True)[0] == 0.72
    lead = rec.LeadEnvelope()
    assert [round(lead.step(h)[0], 4) for h in (0.9, 0.1, 0.1, 0.1)] == [0.9, 0.86, 0.824, 0.5]


def test_circuit_breaker_releases_after_two_steps_outside():
    w = rec.WeeklyWeights()
    got = [w.step(0.3, k, f)[1:] for k, f in ((0, 1), (1, 0), (2, 0))]
    assert [(a, n) for _, a, n in got] == [(True, 0), (True, 1), (False, 2)]
    assert got[2][0] == pytest.approx(0.7)


def test_prototypes_need_four_points_after_a_gap():
    rng = np.random.default_rng(0)
    history = rng.normal(size=(60, 2))
    cov, proto = rec.HuberCovariance(history), None
    proto = rec.Prototypes(history)
    point = proto.centres[2].copy() + 0.01
    for n in range(1, 5):
        before = (cov.reg, cov.root(0.5))
        own = proto.centres[2].copy()
        nearest, shares = proto.update(point, 100 + n, before, cov)
        assert nearest == 2 and sum(shares) == pytest.approx(1)
        assert (not np.allclose(own, proto.centres[2])) == (n == 4)


def test_member_age_survives_a_short_absence(spark):
    rows = [(d, "a", 1.0) for d in range(1, 25) if d != 21] + [(d, "b", 1.0) for d in range(1, 25)]
    ages = micro.member_ages(spark.createDataFrame(rows, "day int, m string, w double"), "day", "m")
    got = {r.day: r.age for r in ages.where("m = 'a'").collect()}
    assert got[20] == 20 and got[22] == 21


def test_concentration_of_equal_series_is_one(spark):
    rows = [(d, m, 100.0 + (d * d) % 17, 0.5) for d in range(20) for m in ("a", "b")]
    out = micro.concentration(spark.createDataFrame(rows, "day int, m string, p double, w double"), "day", "m", "p", "w", 6)
    assert {round(r.concentration, 9) for r in out.collect()} == {1.0}


def test_state_weight_ramps_to_neutral(spark):
    df = spark.createDataFrame([([1.0, 0.0, 0.0, 0.0, 0.0], 1.0), ([1.0, 0.0, 0.0, 0.0, 0.0], 1.9)], "p array<double>, d double")
    assert [r[0] for r in df.select(risk.state_weight(F.col("p"), F.col("d"))).collect()] == pytest.approx([1.0, 0.6])


def test_unknown_inputs_give_no_risk(spark):
    df = spark.createDataFrame([(None, 0.5, 0.6)], "w double, s double, h double")
    assert df.select(risk.risk_score(F.col("w"), F.col("s"), F.col("h"))).first()[0] is None


def test_backtest_first_rows(spark):
    rows = [("r", 1, 0.5, 100.0, 100.0), ("r", 2, 0.7, 110.0, 100.0), ("r", 3, 0.7, 121.0, 100.0)]
    out = portfolio.backtest(spark.createDataFrame(rows, "k string, t int, w double, a double, b double"), "k", "t", "w", "a", "b").orderBy("t").collect()
    assert out[0].gross == pytest.approx(0.05) and out[0].turnover == 0
    assert out[1].turnover == pytest.approx(0.2) and out[1].cost == pytest.approx(0.2 * 0.0005)


def test_order_ledger_sells_fund_buys():
    ledger = policy.OrderSimulation(commission=1.0)
    sold, bought, small = ledger.step(-400.0, 20.0), ledger.step(400.0, 10.0), ledger.step(-49.0, 1.0)
    assert sold[0] == "SELL" and sold[2] == 20 and sold[5] == pytest.approx(1.2) and sold[7] == pytest.approx(398.8)
    assert bought[0] == "BUY" and bought[1] == pytest.approx(397.8 / 1.0015) and bought[6] == 2 and bought[7] >= 0
    assert small[0] is None and small[7] == bought[7]


def test_target_weights_need_a_bucket(spark):
    df = spark.createDataFrame([(True, None, None, "x"), (False, None, None, "x")], "signal_eligible boolean, bucket string, prior map<string,double>, reason string")
    out = policy.target_weights(df.where("NOT signal_eligible"), {"b": {"EQ": 1.0}}, ["EQ", "CASH"], "CASH", "prior").first()
    assert out.target == {"EQ": 0.0, "CASH": 1.0} and out.target_reason == "no_prior_target_defensive_cash_proxy"
    with pytest.raises(Exception, match="no bucket"):
        policy.target_weights(df, {"b": {"EQ": 1.0}}, ["EQ", "CASH"], "CASH", "prior").collect()
    with pytest.raises(ValueError):
        policy.target_weights(df, {"b": {"EQ": 0.9}}, ["EQ", "CASH"], "CASH", "prior")


def test_required_week_turns_at_the_cutoff(spark):
    times = ["2024-01-05 00:00:00", "2024-01-06 11:59:00", "2024-01-06 12:00:00", "2024-01-11 23:00:00"]
    df = spark.createDataFrame([(x,) for x in times], "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
    got = [r[0] for r in df.orderBy("t").select(cycles.required_week(F.col("t"))).collect()]
    assert got == [D(2023, 12, 29), D(2023, 12, 29), D(2024, 1, 5), D(2024, 1, 5)]


def test_canonical_payloads_quote_numbers():
    assert canonical.canonical('{"b": 1.50, "a": [-0.0, 1e2, "\u00e9", null, true]}') == '{"a":["0","100","\\u00e9",null,true],"b":"1.5"}'
    assert canonical.field_set('{"b": [{"c": 1}], "a": {}}') == ["a", "b", "c"]
    assert canonical.holdings_totals('{"holdings": [{"weight": 0.1}, {"weight": "0.20"}, {}]}') == (3, "0.3")
    with pytest.raises(ValueError):
        canonical.canonical("{")


def test_chain_equals_plain_loops():
    """The recursion of covariance and clusters against a version with matrices written out."""
    rng = np.random.default_rng(4)
    points = rng.normal(size=(400, 2)) @ np.array([[1.0, 0.4], [0.0, 0.7]])
    points[200] = [9.0, -9.0]
    cov, rho = rec.HuberCovariance(points[:30]), 2 ** (-1 / 78)
    mean, raw = points[:30].mean(0), np.cov(points[:30].T) + 1e-8 * np.eye(2)

    def regular(m):
        (a, b), (_, d) = m
        middle, half = (a + d) / 2, np.hypot((a - d) / 2, b)
        big, small = max(middle + half, 1e-8), middle - half
        small = max(small, 1e-4 * (middle + half), 1e-8)
        angle = 0.5 * np.arctan2(2 * b, a - d)
        q = np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
        return q @ np.diag([big, small]) @ q.T, q @ np.diag([big**0.5, small**0.5]) @ q.T, q @ np.diag([big**-0.5, small**-0.5]) @ q.T

    for x in points[30:60]:
        cov.update(x)
    for x in points[30:60]:
        gap = x - mean
        weight = min(1.0, 2.5 / max(np.sqrt(gap @ np.linalg.inv(regular(raw)[0]) @ gap), 1e-12))
        mean, raw = rho * mean + (1 - rho) * x, rho * raw + (1 - rho) * weight**2 * np.outer(gap, gap)
    assert cov.mean == pytest.approx(mean) and cov.reg == pytest.approx(regular(raw)[0])
    clusters = rec.Prototypes(points[:60])
    history = points[:60]
    bins = np.array_split(history[np.argsort(history[:, 0])], 5)
    centres, mass = [b.mean(0) for b in bins], [float(len(b)) for b in bins]
    offsets = [regular(np.cov(history.T) + 1e-8 * np.eye(2))[2] @ (c - history.mean(0)) for c in centres]
    last, waiting = [0] * 5, [[] for _ in range(5)]
    for t, x in enumerate(points[60:], 60):
        before = (cov.reg, cov.root(0.5))
        cov.update(x)
        nearest, shares = clusters.update(x, t, before, cov)
        old = regular(raw)
        gap = x - mean
        weight = min(1.0, 2.5 / max(np.sqrt(gap @ np.linalg.inv(old[0]) @ gap), 1e-12))
        mean, raw = rho * mean + (1 - rho) * x, rho * raw + (1 - rho) * weight**2 * np.outer(gap, gap)
        best = min(range(5), key=lambda k: (centres[k] - x) @ np.linalg.inv(old[0]) @ (centres[k] - x))
        for k in range(5):
            if k != best:
                mass[k] *= rho
                centres[k] = mean + old[1] @ offsets[k]
            elif t - last[k] >= 26:
                waiting[k].append(x)
                if len(waiting[k]) == 4:
                    mass[k] *= rho ** (t - last[k])
                    for y in waiting[k]:
                        centres[k], mass[k] = (rho * mass[k] * centres[k] + y) / (rho * mass[k] + 1), rho * mass[k] + 1
                    waiting[k], last[k] = [], t
                else:
                    mass[k] *= rho
            else:
                centres[k], mass[k], last[k] = (rho * mass[k] * centres[k] + x) / (rho * mass[k] + 1), rho * mass[k] + 1, t
        now = regular(raw)
        offsets = [now[2] @ (c - mean) for c in centres]
        d2 = np.array([(c - x) @ np.linalg.inv(now[0]) @ (c - x) for c in centres])
        want = np.exp(-0.5 * (d2 - d2.min()))
        assert nearest == best and shares == pytest.approx(want / want.sum(), rel=1e-6), t
    assert clusters.centres == pytest.approx(np.array(centres)) and clusters.mass == pytest.approx(mass)


def test_materiality_boundary(spark):
    df = spark.createDataFrame([(0.05,), (0.06,), (None,)], "d double")
    assert [r[0] for r in df.select(audit.is_material(F.col("d"))).collect()] == [False, True, False]


def test_runs_and_transitions(spark):
    df = spark.createDataFrame([("s", 1, "k1"), ("s", 2, "k1"), ("s", 3, "k3")], "k string, t int, label string")
    stretches = audit.runs(df, "k", ["t"], "label")
    assert {(r.label, r.steps) for r in stretches.collect()} == {("k1", 2), ("k3", 1)}
    assert audit.transitions(df, "k", ["t"], "label").count() == 2
    assert audit.compressed_sequence(stretches, "k", "label").first().sequence == "k1 -> k3"


def test_cliffs_delta_equals_all_pairs(spark):
    rows = [("a", float(x)) for x in (1, 2, 2, 5)] + [("b", float(x)) for x in (2, 3, 0)]
    want = np.mean([np.sign(x - y) for g, x in rows if g == "a" for h, y in rows if h == "b"])
    got = stats.cliffs_delta(spark.createDataFrame(rows, "g string, v double"), "g", "v", "a", "b").first().delta
    assert got == pytest.approx(want)


def test_tail_approximation(spark):
    import math

    zs = [0.0, 0.5, 1.96, 4.0]
    got = [r[0] for r in spark.createDataFrame([(z,) for z in zs], "z double").select(risk.normal_tail(F.col("z"))).collect()]
    assert got == pytest.approx([math.erfc(z / math.sqrt(2)) for z in zs], abs=2e-7)


@pytest.mark.parametrize("half_life", [5, 0.05])
def test_smoothed_panel_is_the_recursion(spark, half_life):
    """Present and absent days, several blocks of days, and no cell for a day before a member's first."""
    rng = np.random.default_rng(3)
    rows = [(i, m, 1.0, float(rng.uniform(0.1, 1))) for i in range(1, 80) for m in range(4) if not (m == 1 and i % 17 in (3, 4)) and not (m == 2 and i < 9) and not (m == 3 and i > 50)]
    df = spark.createDataFrame(rows, "day int, m int, price double, weight double")
    ages = micro.member_ages(df, "day", "m")
    changes = micro.membership_changes(ages, "day", "m")
    grid = micro.dense(df, "day", "m", "weight").join(changes, "day")
    want = {(r.m, r.ordinal): r.v for r in run_fold(grid, "m", "day", lambda: rec.SmoothedWeights(half_life), ["weight", "changed"], "v double", keep=["ordinal"]).collect()}
    present, absent = micro.smoothed_panel(ages, changes, "m", "weight", half_life)
    got = {(r.m, r.ordinal): r.v for r in present.collect()}
    assert len(got) == len(rows)
    for k, v in got.items():
        assert v == pytest.approx(want[k] or 0.0, rel=1e-9, abs=1e-300)
    gone = sorted((r.ordinal, r.v) for r in absent.collect())
    first = {m: min(i for i, k, *_ in rows if k == m) for m in range(4)}
    lost = sorted((o, v or 0.0) for (m, o), v in want.items() if (m, o) not in got and o > first[m])
    assert [o for o, _ in gone] == [o for o, _ in lost] and [v for _, v in gone] == pytest.approx([v for _, v in lost], rel=1e-9, abs=1e-300)
    assert not any("Python" in x for x in present._jdf.queryExecution().executedPlan().toString().splitlines())


def test_common_concentration_is_that_of_the_pairs(spark):
    rng = np.random.default_rng(4)
    prices = rng.uniform(1, 2, (3, 8))
    held = [(1, m, [0.5, 0.3, 0.4][m], [(o, float(prices[m, o])) for o in range(8) if (m, o) != (1, 4)]) for m in range(3)] + [(2, m, 0.5, [(o, 2.0**o) for o in range(5)]) for m in range(2)] + [(3, 0, 0.5, [(0, 1.0), (1, 2.0), (2, 1.0)])]
    df = spark.createDataFrame(held, "day int, m int, v double, w array<struct<ordinal:int, price:double>>")
    got = {r.day: r.c for r in micro.common_concentration(df, "day", "m").collect()}
    # Member 1 has no returns on days 4 and 5, so nobody's count there.
    r = np.array([[p[o] / p[o - 1] - 1 for o in (1, 2, 3, 6, 7)] for p in prices])
    w = np.array([0.5, 0.3, 0.4]) / 1.2
    rho = np.corrcoef(r) - np.eye(3)
    assert got[1] == pytest.approx(w @ rho @ w / (1 - w @ w)) and got[2] is None and got.get(3) is None
