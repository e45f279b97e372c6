"""The weekly decision chain: factors, state, clusters, stress, drift, risk.

Factors are windows; the two-dimensional recursions run in one ordered pass per
series.  All lengths are parameters, so short histories can be used.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoplane.functions.recursions import EwMean, EwZ, HuberCovariance, LeadEnvelope, Prototypes, Stress
from chronoplane.operators.eigen import EIGEN_COLUMNS, eigen_diagnostics
from chronoplane.operators.folds import run_fold
from chronoplane.operators.risk import risk_score, state_weight
from chronoplane.operators.rolling import Frames, logistic


@dataclass(frozen=True)
class Lengths:
    """Window lengths and half-lives in steps."""

    robust: int = 104
    half_life: int = 260
    short_mean: int = 52
    long_mean: int = 156
    trend_mean: int = 40
    rank: int = 520
    stress: int = 156
    warmup: int = 260
    seed: int = 20


def _dual(df: DataFrame, key: str, order: str, columns: list[str], n: Lengths) -> DataFrame:
    """Add d_<column>: half robust, half exponentially weighted z-score."""
    f = Frames(key, order)

    class All:
        def __init__(self):
            self.each = [EwZ(n.half_life) for _ in columns]

        def step(self, *values):
            return tuple(z.step(v)[0] for z, v in zip(self.each, values))

    slow = run_fold(df, key, order, All, columns, ", ".join(f"e_{c} double" for c in columns))
    both = df.join(slow, [key, order])
    return both.withColumns({f"d_{c}": 0.5 * f.robust_z(F.col(c), n.robust) + 0.5 * F.col(f"e_{c}") for c in columns}).drop(*[f"e_{c}" for c in columns])


def raw_factors(df: DataFrame, key: str, order: str, price: str, n: Lengths) -> DataFrame:
    """Add the price-derived inputs: deviations from means and realised volatility."""
    f, p = Frames(key, order), F.col(price)
    return df.withColumns({"u_short": f.deviation(p, n.short_mean), "u_long": f.deviation(p, n.long_mean), "u_trend": f.deviation(p, n.trend_mean), "rv": f.realized_vol(p)})


def state(df: DataFrame, key: str, order: str, price: str, rates: list[str], fear: str, n: Lengths) -> DataFrame:
    """Add h and i, the level and impulse of the state; ``rates`` are four liquidity inputs."""
    f = Frames(key, order)
    base = raw_factors(df, key, order, price, n).withColumn("_move", f.delta(F.col(rates[1]), 4))
    used = [rates[0], "_move", rates[2], rates[3], "u_short", "u_long", "u_trend", "rv", fear]
    d = _dual(base, key, order, list(dict.fromkeys(used)), n)
    liquidity = -0.25 * (F.col(f"d_{rates[0]}") + F.col("d__move") + F.col(f"d_{rates[2]}") + F.col(f"d_{rates[3]}"))
    heat = 0.5 * (F.col("d_u_short") + F.col("d_u_long"))
    taste = (F.col("d_u_trend") - F.col(f"d_{fear}") - F.col("d_rv")) / 3
    out = d.withColumns({"liquidity": liquidity, "heat": heat, "taste": taste})
    level = 0.40 * F.col("liquidity") + 0.35 * F.col("heat") + 0.25 * F.col("taste")
    impulse = 0.50 * f.delta(F.col("liquidity"), 4) + 0.30 * f.delta(F.col("heat"), 4) + 0.20 * f.delta(F.col("taste"), 4)
    return out.withColumns({"h": level, "i": impulse})


def drift(df: DataFrame, key: str, order: str, price: str, rates: list[str], fear: str, n: Lengths, flag_at: float = 1.8) -> DataFrame:
    """(key, order, drift, drift_flag): slow mean of the ranked level against its own history."""
    f = Frames(key, order)
    base = raw_factors(df, key, order, price, n).withColumn("_move", f.delta(F.col(rates[1]), 4))
    used = [rates[0], "_move", rates[2], rates[3], "u_short", "u_long", "u_trend", "rv", fear]
    held = base.withColumns({f"w_{c}": F.collect_list(c).over(f.last(n.rank)) for c in used})

    def share(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.size(F.filter(f"w_{c}", lambda v: v <= F.col(c))) / F.size(f"w_{c}"))

    rank = {c: share(c) for c in used}
    level = 0.40 * -0.25 * (rank[rates[0]] + rank["_move"] + rank[rates[2]] + rank[rates[3]]) + 0.35 * 0.5 * (rank["u_short"] + rank["u_long"]) + 0.25 * (rank["u_trend"] - rank[fear] - rank["rv"]) / 3
    ranked = held.select(key, order, level.alias("level"))
    slow = run_fold(ranked, key, order, lambda: EwMean(n.half_life), ["level"], "slow double", keep=["level"])
    scored = slow.withColumns({"_med": f.quantile(F.col("level"), n.rank, 0.5), "_mad": f.mad_scale(F.col("level"), n.rank)})
    out = scored.withColumn("drift", (F.col("slow") - F.col("_med")) / (F.col("_mad") + 1e-12))
    return out.select(key, order, "drift", F.coalesce(F.abs("drift") >= flag_at, F.lit(False)).cast("int").alias("drift_flag"))


class _Chain:
    """One ordered pass: covariance, prototypes, stress; the seed is the first known states."""

    def __init__(self, points, n: Lengths):
        known = points[np.isfinite(points).all(axis=1)]
        self.seed = known[: max(2, min(len(known), n.seed))] if len(known) > 1 else np.array([[0.0, 0.0], [1e-6, 0.0]])
        self.n, self.cov, self.stress = n, HuberCovariance(self.seed), Stress(self.seed)
        self.prototypes, self.history, self.t = None, [], -1

    def step(self, x):
        self.t += 1
        ok = bool(np.isfinite(x).all())
        warm, before = self.cov.count >= self.n.warmup, (self.cov.reg, self.cov.root(0.5))
        stress = self.stress.step(*(x if ok else (None, None)))
        self.cov.update(x if ok else None)
        cluster, shares, centres = None, None, None
        if ok and warm:
            if self.prototypes is None:
                self.prototypes = Prototypes(np.array(self.history))
            cluster, shares = self.prototypes.update(x, self.t, before, self.cov)
            centres = [{"h": float(h), "i": float(i)} for h, i in self.prototypes.centres]
        if ok:
            self.history.append(x)
        raw = self.cov.raw
        return [cluster, shares, centres, stress[2], stress[3], stress[4], self.cov.distance, self.cov.weight, self.cov.count, float(raw[0, 0]), float(raw[0, 1]), float(raw[1, 1])]


_MADE = "cluster int, shares array<double>, centres array<struct<h: double, i: double>>, d double, a double, g_raw double, distance double, weight double, n_seen int, cov_hh double, cov_hi double, cov_ii double"


def _passed(states: DataFrame, key: str, order: str, keep: list[str], n: Lengths) -> DataFrame:
    """The rows' h and i with what one ordered pass over each key makes of them."""
    made_by_chain = T._parse_datatype_string("h double, i double, " + _MADE)
    schema = T.StructType([*states.select(key, order, *keep).schema.fields, *made_by_chain.fields])
    names = [f.name for f in made_by_chain.fields[2:]]

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        points = pdf[["h", "i"]].to_numpy(float)
        machine = _Chain(points, n)
        made = pd.DataFrame([machine.step(x) for x in points], columns=names)
        made["cluster"] = made["cluster"].astype("Int32")
        for c in ("d", "a", "g_raw"):
            made[c] = made[c].astype(float)
        return pd.concat([pdf, made], axis=1)

    passed = states.select(key, order, *keep, "h", "i").groupBy(key).applyInPandas(chain, schema)
    return passed.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("h", "i", "d", "a", "g_raw")})


def _stressed(passed: DataFrame, key: str, order: str, exo: str, n: Lengths) -> DataFrame:
    """Add g, the stress of the state and of the outside together, and its logistic s."""
    f = Frames(key, order)
    g = 0.5 * f.robust_z(F.col("g_raw"), n.stress) + 0.5 * f.robust_z(F.col(exo), n.stress)
    return passed.withColumn("g", g).withColumn("s", logistic(F.col("g")))


def semantic_label(centres: Column, cluster: Column) -> Column:
    """The name of one of five clusters by all their centres, an array of (h, i).

    By level the two lowest are S1 and S2, the lower impulse first, the middle is S3,
    and of the two highest the one with the higher impulse is S4; ties go by place.
    """
    by_level = F.array_sort(F.transform(centres, lambda c, k: F.struct(c["h"].alias("h"), k.alias("k"), c["i"].alias("i"))))
    pair = lambda at, sign: F.array_sort(F.transform(F.slice(by_level, at, 2), lambda c, p: F.struct((sign * c["i"]).alias("i"), p.alias("p"), c["k"].alias("k"))))
    names = F.concat(F.transform(pair(1, 1), lambda c: c["k"]), F.transform(F.slice(by_level, 3, 1), lambda c: c["k"]), F.transform(pair(4, -1), lambda c: c["k"]))
    return F.when(cluster.isNotNull(), F.concat(F.lit("S"), F.array_position(names, cluster).cast("string")))


def replay_table(df: DataFrame, key: str, order: str, price: str, rates: list[str], fear: str, exo: str, n: Lengths) -> DataFrame:
    """The diagnostic record per step, 26 columns beside the key: factors, shares and label, stress, drift, and the covariance's health.

    Distance and weight are those of the last known step; until the covariance is
    warm the label is ``WARMUP``.  The label is that of the most probable cluster.
    """
    states = state(df, key, order, price, rates, fear, n)
    passed = _passed(states, key, order, list(dict.fromkeys([exo, "liquidity", "heat", "taste"])), n)
    full = eigen_diagnostics(_stressed(passed, key, order, exo, n), "cov_hh", "cov_hi", "cov_ii").join(drift(df, key, order, price, rates, fear, n), [key, order])
    most = F.array_position("shares", F.array_max("shares")).cast("int") - 1
    return full.select(
        key,
        F.col(order).alias("week_end"),
        *[F.col(c).alias(name) for c, name in (("liquidity", "l_t"), ("heat", "t_t"), ("taste", "p_t"), (exo, "e_t"), ("h", "h_t"), ("i", "i_t"))],
        F.to_json(F.transform("shares", lambda x: F.round(x, 10))).alias("state_probs_json"),
        F.coalesce(semantic_label(F.col("centres"), most), F.lit("WARMUP")).alias("state_label"),
        *[F.col(c).alias(name) for c, name in (("d", "d_t"), ("a", "a_t"), ("g_raw", "g_t_raw"), ("g", "g_t_stress"), ("s", "s_t"), ("drift", "drift_probe_raw"))],
        "drift_flag",
        F.col("cov_ok").alias("state_ok"),
        (F.col("n_seen") >= n.warmup).alias("is_warm"),
        *[F.when(F.col("n_seen") > 0, F.col(c)).alias(name) for c, name in (("distance", "maha"), ("weight", "huber_weight"), *[(e, e) for e in EIGEN_COLUMNS])],
    )


def decision_records(df: DataFrame, key: str, order: str, price: str, rates: list[str], fear: str, exo: str, micro: str, n: Lengths) -> DataFrame:
    """The full record per step: state, cluster and shares, stress, drift, lead and risk.

    Until the covariance is warm the mode is ``warmup`` and there is no score.
    """
    states = state(df, key, order, price, rates, fear, n)
    stressed = _stressed(_passed(states, key, order, list(dict.fromkeys([exo, micro])), n), key, order, exo, n)
    led = run_fold(stressed, key, order, LeadEnvelope, [micro], "lead double, calm int, lead_status string", keep=["h", "i", "cluster", "shares", "distance", "weight", "n_seen", "s"])
    full = led.join(drift(df, key, order, price, rates, fear, n), [key, order])
    scored = full.withColumn("omega", F.when(F.col("shares").isNotNull(), state_weight(F.col("shares"), F.coalesce("drift", F.lit(0.0)))))
    scored = scored.withColumn("rho", risk_score(F.col("omega"), F.col("s"), F.col("lead")))
    return scored.withColumn("mode", F.when(F.col("cluster").isNull(), "warmup").when(F.col("rho").isNull(), "degraded").otherwise("strict"))
