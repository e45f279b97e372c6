"""Per-column as-of reads, splices, eigen diagnostics, scenarios, regimes, warm-up, and state that outlives a run."""

import datetime as dt
import json
import math
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoplane.functions.recursions import Covariance2D, EwMean, EwZ
from chronoplane.operators import audit, eigen, pit, ranking, regimes, scenarios, splices, state, stats, warmup
from chronoplane.operators.folds import run_fold
from chronoplane.streaming import state as streams


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(n)


# per-column as-of


def test_each_column_has_its_own_last_value_and_limit(spark):
    right = spark.createDataFrame([("a", day(0), 1.0, 10.0), ("a", day(2), None, 20.0), ("a", day(2), 3.0, None), ("a", day(100), None, 30.0), ("b", day(1), 7.0, None)], "k string, t date, x double, y double")
    left = spark.createDataFrame([("a", day(-1), 0), ("a", day(1), 1), ("a", day(2), 2), ("a", day(2), 2), ("a", day(6), 3), ("a", day(101), 4), ("b", day(1), 5), ("c", day(1), 6), (None, day(1), 7)], "k string, t date, x_id int")
    got = {r.x_id: (r.x, r.x_at, r.y, r.y_at) for r in pit.asof_frame(left, right, "k", "t", {"x": None, "y": "3 days"}).collect()}
    assert got[0] == (None, None, None, None) and got[1] == (1.0, day(0), 10.0, day(0)) and got[2] == (3.0, day(2), 20.0, day(2))
    assert got[3] == (3.0, day(2), None, None) and got[4] == (3.0, day(2), 30.0, day(100)) and got[5] == (7.0, day(1), None, None)
    assert got[6] == got[7] == (None, None, None, None) and pit.asof_frame(left, right, "k", "t", {"x": None}).count() == 9


@pytest.mark.parametrize("span", ["week", "month", "year"])
def test_spans_change_nothing_and_the_future_is_unseen(spark, span):
    rng = np.random.default_rng(1)
    rows = [(int(rng.integers(3)), day(int(rng.integers(400))), float(v) if (v := rng.normal()) > -0.5 else None) for _ in range(300)]
    asked = [(int(rng.integers(3)), day(int(rng.integers(400)))) for _ in range(100)]
    right, left = spark.createDataFrame(rows, "k int, t date, x double").dropDuplicates(["k", "t"]), spark.createDataFrame(asked, "k int, t date")
    known = [(r.k, r.t, r.x) for r in right.collect() if r.x is not None]
    got = pit.asof_frame(left, right, "k", "t", {"x": "40 days"}, span).collect()
    for r in got:
        best = max(((t, x) for k, t, x in known if k == r.k and r.t - dt.timedelta(40) <= t <= r.t), default=(None, None))
        assert (r.x_at, r.x) == best


# splices


def test_precedence_keeps_conflicts_as_rows(spark):
    rows = [("a", 1, "s1", 1.0), ("a", 1, "s2", 1.0), ("a", 2, "s2", 2.0), ("a", 2, "zz", 2.5), ("a", 3, "s1", None), ("a", 3, "yy", 3.0), ("a", 3, "zz", 3.0), ("a", 4, "s1", 4.0), ("a", 4, "s1", 5.0)]
    obs = spark.createDataFrame(rows, "k string, t int, s string, v double")
    got = {r.t: tuple(r)[2:] for r in splices.by_precedence(obs, ["k", "t"], "s", "v", ["s1", "s2"], 0.1).collect()}
    assert got == {1: (1.0, "s1", 2, 0.0, "ok"), 2: (2.0, "s2", 2, 0.5, "conflict"), 3: (3.0, "yy", 2, 0.0, "ok"), 4: (5.0, "s1", 1, None, "ok")}
    checks = {r.s: tuple(r)[2:] for r in splices.overlap_checks(obs.where("s <> 'yy'"), "k", ["t"], "s", "v", ["s1", "s2", "zz"], 0.1).collect()}
    assert checks == {"s2": (1, 0.0, 0.1, "ok"), "zz": (1, 0.5, 0.1, "conflict")}


@pytest.mark.parametrize("p", [1, 2, 4])
def test_least_squares_of_any_width(spark, p):
    rng = np.random.default_rng(p)
    x = rng.normal(size=(60, p)) + 5
    y = x @ np.arange(1, p + 1) + 3 + rng.normal(size=60) * 0.1
    rows = [("a", *map(float, r), float(v)) for r, v in zip(x, y)] + [("a", *[None] * p, 1.0), ("a", *[1.0] * p, None)]
    df = spark.createDataFrame(rows, "k string, " + ", ".join(f"x{i} double" for i in range(p)) + ", y double")
    got = splices.fit_ols(df, "k", "y", [f"x{i}" for i in range(p)]).first()
    want = np.linalg.lstsq(np.column_stack([x, np.ones(60)]), y, rcond=None)[0]
    assert got["n"] == 60 and got["slopes"] == pytest.approx(want[:p]) and got["intercept"] == pytest.approx(want[p])
    assert got["r2"] == pytest.approx(1 - np.sum((y - np.column_stack([x, np.ones(60)]) @ want) ** 2) / np.sum((y - y.mean()) ** 2))


def test_a_dependent_regressor_has_no_slope(spark):
    df = spark.createDataFrame([("a", float(i), 2.0 * i, 3.0 * i + 1) for i in range(9)], "k string, a double, b double, y double")
    got = splices.fit_ols(df, "k", "y", ["a", "b"]).first()
    assert got["slopes"] == pytest.approx([3.0, 0.0]) and got["intercept"] == pytest.approx(1.0) and got["r2"] == pytest.approx(1.0)


def test_splice_predicts_the_past_within_bounds_and_falls_back(spark):
    long = [("a", t, None if t < 10 else 2.0 * t + (t % 3), float(t), float(t % 3)) for t in range(30)]
    # Four common rows are too few for three parameters twice over: one regressor.
    short = [("b", t, None if t < 8 else 5.0 * t, float(t), None if t == 2 else 1.0 * (t % 2)) for t in range(12)]
    none = [("c", t, None, 1.0, 1.0) for t in range(3)]
    df = spark.createDataFrame(long + short + none, "k string, t int, y double, a double, b double")
    got = {(r.k, r.t): (r.y, r.origin) for r in splices.ols_splice(df, "k", "t", "y", ["a", "b"], 3.0, 12.0).collect()}
    assert got["a", 4] == (pytest.approx(9.0), "predicted") and got["a", 8] == (12.0, "predicted") and got["a", 0] == (3.0, "predicted") and got["a", 10] == (21.0, "observed")
    assert got["b", 2] == (pytest.approx(10.0), "predicted") and got["b", 1] == (pytest.approx(5.0), "predicted") and not any(k == "c" for k, _ in got)


# eigen diagnostics


def test_eigen_columns_equal_numpy(spark):
    rng = np.random.default_rng(2)
    mats = [np.cov(rng.normal(size=(2, 5)) * [[1.0], [s]]) for s in (1, 1e-3, 1e-9, 50)] + [np.zeros((2, 2)), np.eye(2) * 3, np.array([[1.0, 2.0], [2.0, 1.0]]), np.diag([1e-3, 1e-12])]
    df = spark.createDataFrame([(i, float(m[0, 0]), float(m[0, 1]), float(m[1, 1])) for i, m in enumerate(mats)] + [(99, None, 1.0, 1.0)], "i int, a double, b double, c double")
    got = {r.i: r for r in eigen.regularised(eigen.eigen_diagnostics(df, "a", "b", "c"), "a", "b", "c").collect()}
    assert not got[99].cov_ok and got[99].eigval_1 is None and not got[6].cov_ok and got[6].condition_number_reg is None
    for i, m in enumerate(mats):
        low, top = np.linalg.eigvalsh(m)
        if i != 6:
            first = max(top, 1e-8)
            second = max(low, 1e-4 * first, 1e-8)
            r = got[i]
            assert (r.eigval_1, r.eigval_2_reg, r.condition_number_reg) == pytest.approx((first, second, first / second), rel=1e-9)
            assert r.eigval_2_raw == pytest.approx(low, rel=1e-6, abs=1e-15) and r.eigval_2_was_floored == bool(low < 1e-4 * first or low < 1e-8)
            values, vectors = np.linalg.eigh(m)
            whole = (vectors * [second, first]) @ vectors.T
            assert (r.reg_a, r.reg_b, r.reg_c) == pytest.approx((whole[0, 0], whole[0, 1], whole[1, 1]), rel=1e-9, abs=1e-15)


def test_replay_table_has_its_columns_and_labels(spark):
    n = state.Lengths(robust=8, half_life=8, short_mean=4, long_mean=6, trend_mean=4, rank=12, stress=8, warmup=30, seed=8)
    rng = np.random.default_rng(3)
    rows = [("a", day(i), float(100 * math.exp(rng.normal() * 0.1)), *map(float, rng.normal(size=5))) for i in range(160)]
    df = spark.createDataFrame(rows, "k string, t date, p double, r1 double, r2 double, r3 double, r4 double, f double")
    got = state.replay_table(df, "k", "t", "p", ["r1", "r2", "r3", "r4"], "f", "r1", n)
    rows = got.orderBy("week_end").collect()
    assert len(got.columns) == 27 and len(rows) == 160
    warm = [r for r in rows if r.state_label != "WARMUP"]
    assert len(warm) > 50 and {r.state_label for r in warm} <= {"S1", "S2", "S3", "S4", "S5"} and all(r.is_warm and r.state_ok for r in warm)
    assert all(sum(json.loads(r.state_probs_json)) == pytest.approx(1, abs=1e-8) for r in warm)
    full = {r.t: r for r in state.decision_records(df, "k", "t", "p", ["r1", "r2", "r3", "r4"], "f", "r1", "r2", n).collect()}
    assert all((r.h_t, r.i_t, r.maha, r.s_t) == (full[r.week_end].h, full[r.week_end].i, full[r.week_end].distance, full[r.week_end].s) for r in warm)


def test_labels_follow_level_and_impulse(spark):
    centres = [(0.0, 2.0), (5.0, 1.0), (1.0, -1.0), (9.0, 3.0), (8.0, 4.0)]
    df = spark.createDataFrame([(centres, k) for k in range(5)] + [(centres, None)], "c array<struct<h: double, i: double>>, k int")
    assert [r.l for r in df.select(state.semantic_label(F.col("c"), F.col("k")).alias("l")).collect()] == ["S2", "S3", "S1", "S5", "S4", None]


# scenarios


def test_scenarios_run_beside_the_base(spark):
    df = spark.createDataFrame([(k, t, float(t), 1.0) for k in ("a", "b") for t in range(4)], "k string, t int, x double, y double")
    sums = lambda rows, run: rows.groupBy(run, "t").agg(F.sum(F.col("x") + F.col("y")).alias("z"))
    made = scenarios.replayed(df, "k", "t", {"up": {"x": F.col("x") + 1}, "gone": {"y": F.lit(None).cast("double"), "x": F.col("y") * 10}}, sums)
    got = {(r.scenario, r.k, r.t): r.d_z for r in scenarios.differences(made, "k", "t", ["z"]).collect()}
    assert len(got) == 16 and got["up", "a", 2] == 1.0 and got["gone", "b", 3] is None
    summary = {r.scenario: (r.n_z, r.mean_abs_z, r.max_abs_z) for r in scenarios.sensitivity_summary(scenarios.differences(made, "k", "t", ["z"]), ["z"]).collect()}
    assert summary == {"up": (8, 1.0, 1.0), "gone": (0, None, None)}
    with pytest.raises(ValueError):
        scenarios.exploded(df, "k", {"base": {}})


# regimes


def test_open_runs_stand_apart_from_closed_ones(spark):
    labels = {"u": "AABBBAAAA", "v": "AAAB", "w": "C"}
    rows = [(u, t, x, None if x == "C" else {"A": 1, "B": 2}[x]) for u, xs in labels.items() for t, x in enumerate(xs)]
    made = regimes.labelled_runs(spark.createDataFrame(rows, "u string, t int, mode string, k int"), "u", ["t"], "mode", "k")
    summary = {r.label: r for r in regimes.duration_summary(made).collect()}
    a = summary["A:k1"]
    assert (a.run_count, a.closed_count, a.closed_median, a.closed_max, a.max_steps, a.latest_start, a.latest_steps) == (3, 2, 2.5, 3, 4, 5, 4)
    assert (summary["C"].closed_count, summary["C"].closed_median, summary["C"].cluster) == (0, None, None)
    running = {r.u: (r.label, r.steps, r.closed_runs, r.percentile) for r in regimes.running_regimes(made, "u").collect()}
    assert running == {"u": ("A:k1", 4, 2, 1.0), "v": ("B:k2", 1, 1, 0.0), "w": ("C", 1, 0, None)}


# warm-up


def test_needs_propagate_and_the_binding_input_is_named(spark):
    rows = [("a", day(t), 1.0, 1.0 if t >= 4 else None, 1.0 if t >= 6 else None) for t in range(12)] + [("b", day(t), 1.0, None, None) for t in range(3)]
    df = spark.createDataFrame(rows, "k string, t date, x double, y double, late double")
    stages = [warmup.Stage("late", ("x", "m")), warmup.Stage("m", ("x", "y"), 2, 1)]
    got = {(r.k, r.stage): r for r in warmup.dependency_map(df, "k", "t", ["x", "y"], stages).collect()}
    m, late = got["a", "m"], got["a", "late"]
    assert (m.ready_row, m.ready, m.binding_parent, m.binding_input, m.observed) == (7, day(6), "y", "y", None)
    assert (late.ready, late.binding_parent, late.binding_input, late.observed) == (day(6), "m", "y", day(6)) and got["b", "late"].ready is None
    chains = {r.k: r.chain for r in warmup.explained(warmup.dependency_map(df, "k", "t", ["x", "y"], stages), "k", "late").collect()}
    assert chains["a"] == "late <- m <- y"
    with pytest.raises(ValueError, match="a, b"):
        warmup.ordered([warmup.Stage("a", ("b",)), warmup.Stage("b", ("a",))], ["x"])


# state that outlives a run


@pytest.fixture()
def rocks(spark):
    before = spark.conf.get(streams.STORE)
    spark.conf.set(streams.STORE, streams.ROCKS)
    yield spark
    spark.conf.set(streams.STORE, before)


def series(n, keys=("a", "b")):
    rng = np.random.default_rng(9)
    return [(k, dt.datetime(2024, 1, 1) + dt.timedelta(i), float(rng.normal()) if i % 7 else None) for k in keys for i in range(n)]


SERIES = "k string, t timestamp, x double"


def drained(query):
    query.awaitTermination(120)
    return query


@pytest.mark.parametrize("make, outputs", [(lambda: EwZ(8), "z double"), (lambda: EwMean(5), "m double")])
def test_a_stream_goes_on_where_a_batch_ended(rocks, make, outputs):
    rows, root = series(40), tempfile.mkdtemp(prefix="spark-")
    early = rocks.createDataFrame([r for r in rows if r[1] < dt.datetime(2024, 1, 21)], SERIES)
    streams.fold_states(early, "k", "t", make, ["x"], keep_rows=3).write.parquet(f"{root}/seed")
    # One row was in the seed already: it isn't fed again.
    rest = [r for r in rows if r[1] >= dt.datetime(2024, 1, 20)]
    rocks.createDataFrame(rest[: len(rest) // 2], SERIES).coalesce(1).write.parquet(f"{root}/in")
    rocks.createDataFrame(rest[len(rest) // 2 :] + [("new", dt.datetime(2024, 2, 1), 1.0)], SERIES).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = rocks.readStream.schema(SERIES).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    out = streams.continued_fold(stream, "k", "t", make, ["x"], outputs, rocks.read.parquet(f"{root}/seed"), keep_rows=3)
    drained(out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/cp").trigger(availableNow=True).start())
    name = outputs.split()[0]
    got = {(r.k, r.t): (r[name], r.rows_held) for r in rocks.read.parquet(f"{root}/out").collect()}
    whole = run_fold(rocks.createDataFrame(rows, SERIES), "k", "t", make, ["x"], outputs).where("t >= '2024-01-21'").collect()
    assert len(got) == len(whole) + 1 and got["new", dt.datetime(2024, 2, 1)][1] == 1
    for r in whole:
        value, held = got[r.k, r.t]
        assert held == 3 and (value == pytest.approx(r[name]) if r[name] is not None else value is None or value != value)


def test_kept_rows_are_forgotten_by_age(rocks):
    """A row's time to live is over before the second file comes: only the newest is held."""
    root = tempfile.mkdtemp(prefix="spark-")
    write = lambda rows: rocks.createDataFrame(rows, SERIES).coalesce(1).write.mode("append").parquet(f"{root}/in")
    write(series(5, ("a",)))
    for part in range(2):
        stream = rocks.readStream.schema(SERIES).parquet(f"{root}/in")
        out = streams.continued_fold(stream, "k", "t", lambda: EwMean(5), ["x"], "m double", keep_rows=10, ttl_ms=1)
        drained(out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/cp").trigger(availableNow=True).start())
        write([("a", dt.datetime(2024, 3, 1), 1.0)])
    got = {r.t: r.rows_held for r in rocks.read.parquet(f"{root}/out").collect()}
    assert got[dt.datetime(2024, 1, 5)] == 5 and got[dt.datetime(2024, 3, 1)] == 1


def test_continued_state_needs_the_typed_store(spark):
    stream = spark.readStream.format("rate").load().selectExpr("CAST(value AS STRING) AS k", "timestamp AS t", "1.0D AS x")
    with pytest.raises(ValueError, match="providerClass"):
        streams.continued_fold(stream, "k", "t", lambda: EwMean(5), ["x"], "m double")


def test_late_and_missing_weeks_are_told_by_timers(rocks):
    root, friday = tempfile.mkdtemp(prefix="spark-"), dt.datetime(2024, 1, 5)
    week = lambda n: friday + dt.timedelta(7 * n)
    at = lambda n, hours: week(n) + dt.timedelta(hours=hours)
    schema = "k string, w timestamp, at timestamp"
    # Just in time, at the cutoff, after it, never, and after it was told missing.
    batches = [[("a", week(0), at(0, 1)), ("b", week(0), at(0, 2))], [("a", week(1), at(1, 24)), ("b", week(1), at(1, 25))], [("a", week(3), at(3, 3)), ("a", week(1), at(3, 4))], [("b", week(4), at(4, 1)), ("a", week(2), at(4, 30))], [("a", week(4), at(5, 30))]]
    for i, rows in enumerate(batches):
        rocks.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{root}/in/{i}")
        stream = rocks.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{root}/in")
        told = streams.deadlines(stream, "k", "w", "at", "24 hours")
        drained(told.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/cp").trigger(availableNow=True).start())
    got = {}
    for r in rocks.read.parquet(f"{root}/out").orderBy("period").collect():
        got.setdefault((r.k, (r.period - friday).days // 7), []).append(r.status)
    assert got["a", 0] == got["b", 0] == ["on_time"] and got["a", 1] == ["on_time"] and got["b", 1] == ["late"]
    assert sorted(got["a", 2]) == ["late", "missing"] and got["a", 3] == ["on_time"] and got["b", 2] == got["b", 3] == ["missing"]
    assert got["b", 4] == ["on_time"] and sorted(got["a", 4]) in (["late"], ["late", "missing"])


def test_a_replayed_batch_publishes_its_run_once(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    first = spark.createDataFrame([("2024-01-05", "a", 1.0), ("2024-01-05", "b", 2.0), (None, "c", 3.0)], "run_id string, k string, v double")
    second = spark.createDataFrame([("2024-01-12", "a", 5.0), ("2024-01-05", "a", 99.0)], first.schema)
    streams.deliver_batch(first, 0, root)
    streams.deliver_batch(first, 0, root)
    streams.deliver_batch(second, 1, root)
    assert sorted((r.run, r.batch_id, r.rows) for r in streams.published_runs(spark, root).collect()) == [("2024-01-05", 0, 2), ("2024-01-12", 1, 1)]
    assert sorted(map(tuple, streams.published(spark, root).collect())) == [("2024-01-05", "a", 1.0), ("2024-01-05", "b", 2.0), ("2024-01-12", "a", 5.0)]


def test_a_run_that_failed_before_its_ledger_row_is_delivered_whole(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    half = spark.createDataFrame([("7", "a", 1.0)], "run_id string, k string, v double")
    half.selectExpr("*", "'run-7' AS _run_key").write.partitionBy("_run_key").parquet(f"{root}/data")
    assert streams.published(spark, root).count() == 0
    streams.deliver_batch(half.union(half), 3, root)
    assert streams.published(spark, root).count() == 2 and streams.published_runs(spark, root).first()["rows"] == 2


def test_a_stream_without_its_checkpoint_publishes_nothing_twice(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    spark.createDataFrame([("r1", 1), ("r2", 2)], "run_id string, v int").write.parquet(f"{root}/in")
    for checkpoint in ("c1", "c2"):
        stream = spark.readStream.schema("run_id string, v int").parquet(f"{root}/in")
        drained(streams.publish_once(stream, f"{root}/out", f"{root}/{checkpoint}").trigger(availableNow=True).start())
    assert streams.published_runs(spark, f"{root}/out").count() == 2 and streams.published(spark, f"{root}/out").count() == 2


def test_a_covariance_recursion_survives_its_seed(rocks):
    """State of several parts: the machine that a batch wrote goes on unchanged."""
    rng = np.random.default_rng(4)
    history = rng.normal(size=(20, 2)).tolist()
    make = lambda: Covariance2D(history)
    rows = [("a", dt.datetime(2024, 1, 1) + dt.timedelta(i), *map(float, rng.normal(size=2))) for i in range(12)]
    schema = "k string, t timestamp, x double, y double"
    seeds = streams.fold_states(rocks.createDataFrame(rows[:6], schema), "k", "t", make, ["x", "y"]).collect()
    import pickle

    machine = pickle.loads(bytes(seeds[0].machine))
    outputs = "a double, b double, c double, d double, e double, f double, g double, dist double, w double, n long, owed long"
    want = run_fold(rocks.createDataFrame(rows, schema), "k", "t", make, ["x", "y"], outputs).orderBy("t").collect()
    for r, w in zip(rows[6:], want[6:]):
        assert machine.step(*r[2:])[:9] == pytest.approx(tuple(w)[2:11])
    assert seeds[0].at == rows[5][1] and pd.isna(seeds[0].tail).all() if len(seeds[0].tail) else True


# ranks and quantiles by ranges


@pytest.mark.parametrize("ranges", [1, 2, 7, 64])
def test_ranges_change_no_rank_and_no_quantile(spark, ranges):
    rng = np.random.default_rng(5)
    rows = [(k, float(v) if v is not None else None) for k in ("a", "b", None) for v in [*np.round(rng.lognormal(size=80), 1), None, 3.0, 3.0]] + [("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    frame = pd.DataFrame(rows, columns=["k", "v"]).dropna(subset=["v"])
    want = {(k, v): (int((g == v).sum()), int((g < v).sum()), len(g)) for k in ("a", "b", None) for g in [frame.v[frame.k.isna() if k is None else frame.k == k]] for v in g}
    counted = ranking.cumulative(df, ["k"], "v", ranking.split_points(df, "v", ranges)).collect()
    assert {(r.k, r.v): tuple(r)[2:] for r in counted} == want and len(counted) == len(want)
    got = {r.k: tuple(r)[1:] for r in ranking.quantiles(df, ["k"], "v", {"lo": 0.05, "mid": 0.5, "top": 1.0}, ranges).collect()}
    for k, (n, *values) in got.items():
        g = frame.v[frame.k.isna() if k is None else frame.k == k]
        assert n == len(g) and values == pytest.approx(np.quantile(g, [0.05, 0.5, 1.0]).tolist())
    assert set(got) == {"a", "b", None}


def test_rank_tests_order_no_sample_in_one_task(spark):
    df = spark.createDataFrame([("a" if i % 2 else "b", float(i)) for i in range(200)], "g string, v double")
    plan = stats.rank_sums(df, "g", "v")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "windowspecdefinition" in line]
    # One is over ranges, the other over the ranges' totals.
    assert len(windows) >= 2 and sum("_r#" in line.split("windowspecdefinition")[1].split("specifiedwindowframe")[0] for line in windows) >= 2
    assert {r.g: (r.n, r.rank_sum) for r in stats.rank_sums(df, "g", "v").collect()} == {"a": (100, 10100.0), "b": (100, 10000.0)}
    assert {r.g: r.n for r in audit.distribution(df.unionByName(spark.createDataFrame([("c", None)], df.schema)), "g", "v").collect()} == {"a": 100, "b": 100, "c": 0}


def test_rank_tests_pass_64_bits(spark):
    df = spark.range(3_000_000).select((F.col("id") % 2).cast("string").alias("g"), F.when(F.col("id") < 2_500_000, 1.0).otherwise(2.0).alias("v"))
    sums = stats.rank_sums(df, "g", "v")
    assert {(r.total, r.ties) for r in sums.collect()} == {(3_000_000, float(2_500_000**3 - 2_500_000) + float(500_000**3 - 500_000))}
    out = stats.kruskal(sums, 5).first()
    assert out.total == 3_000_000 and abs(out.h) < 1e-6 and abs(out.p_value - 1) < 1e-6
