"""State machines of the engine: exponentially weighted moments, breakers, clusters.

Each has ``step``; an input of None is missing.  How a gap is treated differs and
matters: means hold their state, covariances owe the decay of the missed steps.
"""

from __future__ import annotations

import math

import numpy as np


def decay(half_life: float) -> float:
    return 2.0 ** (-1.0 / half_life)


class EwMean:
    """Exponentially weighted mean; a gap repeats the last mean."""

    def __init__(self, half_life: float):
        self.rho, self.mean = decay(half_life), None

    def step(self, x):
        if x is not None:
            self.mean = x if self.mean is None else self.rho * self.mean + (1 - self.rho) * x
        return (self.mean,)


class EwZ:
    """Z-score by exponentially weighted moments.

    The variance learns from the distance to the mean before the step; the score
    uses the mean after it.  ``clip`` bounds that distance in standard deviations.
    A score needs more than a quarter half-life of values, and at least three.
    """

    def __init__(self, half_life: float, clip: float | None = None, eps: float = 1e-12):
        self.rho, self.clip, self.eps = decay(half_life), clip, eps
        self.least, self.seen, self.mean, self.var = max(2, half_life // 4), 0, None, 0.0

    def step(self, x):
        if x is None:
            return (None,)
        self.seen += 1
        if self.mean is None:
            self.mean = x
            return (None,)
        gap = x - self.mean
        if self.clip is not None:
            bound = self.clip * math.sqrt(self.var + self.eps)
            gap = min(max(gap, -bound), bound)
        self.mean = self.rho * self.mean + (1 - self.rho) * x
        self.var = self.rho * self.var + (1 - self.rho) * gap * gap
        return ((x - self.mean) / math.sqrt(self.var + self.eps) if self.seen > self.least else None,)


class EwCorrelation:
    """Exponentially weighted correlation of two series; a gap in either skips the step."""

    def __init__(self, half_life: float = 78, eps: float = 1e-12):
        self.rho, self.eps, self.means, self.moments = decay(half_life), eps, None, (0.0, 0.0, 0.0)

    def step(self, x, y):
        if x is None or y is None:
            return (None,)
        if self.means is None:
            self.means = x, y
            return (None,)
        r, (mx, my), (xy, xx, yy) = self.rho, self.means, self.moments
        dx, dy = x - mx, y - my
        self.moments = xy, xx, yy = r * xy + (1 - r) * dx * dy, r * xx + (1 - r) * dx * dx, r * yy + (1 - r) * dy * dy
        self.means = r * mx + (1 - r) * x, r * my + (1 - r) * y
        return (min(1.0, max(-1.0, xy / (math.sqrt(xx * yy) + self.eps))),)


class LeadEnvelope:
    """Fragility lead: decays by delta, heals after some calm steps, can be frozen.

    A frozen step changes nothing; a missing value decays and forgets healing.
    """

    def __init__(self, delta: float = 0.9, heal_below: float = 0.25, heal_steps: int = 3, start: float = 0.5):
        self.delta, self.heal_below, self.heal_steps = delta, heal_below, heal_steps
        self.lead, self.calm = start, 0

    def step(self, h, frozen=False):
        if frozen:
            return self.lead, self.calm, "frozen"
        excess, status = self.delta * max(self.lead - 0.5, 0.0), "inactive"
        if h is None:
            self.calm, status = 0, "missing"
        else:
            excess = max(h - 0.5, excess, 0.0)
            self.calm = self.calm + 1 if h < self.heal_below else 0
            if self.calm:
                status = "healing"
            if self.calm >= self.heal_steps:
                excess, self.calm, status = 0.0, 0, "reset"
        self.lead = 0.5 + excess
        return self.lead, self.calm, status


class WeeklyWeights:
    """Target weight from a risk score under a circuit breaker and a turnover band.

    The breaker starts when the first cluster coincides with a drift flag, forces
    weight 0, and is released after ``release`` known steps in a row elsewhere; an
    unknown cluster restarts that count.  A change smaller than the band is dropped.
    """

    def __init__(self, first_cluster: int = 0, release: int = 2, band: float = 0.05):
        self.first, self.release, self.band = first_cluster, release, band
        self.active, self.outside, self.held = False, 0, None

    def step(self, rho, cluster, drift):
        if self.active:
            self.outside = self.outside + 1 if cluster is not None and cluster != self.first else 0
            if self.outside >= self.release:
                self.active = False
        elif cluster == self.first and drift == 1:
            self.active, self.outside = True, 0
        target = 0.0 if self.active else 1.0 - min(1.0, max(0.0, rho))
        if self.active or self.held is None or abs(target - self.held) >= self.band:
            self.held = target
        return target, self.held, self.active, self.outside


def floored(cov, eps_abs: float = 1e-8, eps_rel: float = 1e-4):
    """(regularised matrix, eigenvalues descending, eigenvectors) of a symmetric 2x2 matrix.

    The smaller eigenvalue is raised to a share of the larger one.
    """
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    if values[1] < -eps_abs:
        raise ValueError("the covariance isn't positive")
    values = np.array([max(values[0], eps_abs), max(values[1], eps_rel * values[0], eps_abs)])
    return (vectors * values) @ vectors.T, values, vectors


class HuberCovariance:
    """Exponentially weighted mean and covariance of 2-vectors, outliers shrunk.

    Distances are measured by the covariance before the step.  Missed steps are
    owed: the next known vector decays the state by all of them.
    """

    def __init__(self, history, half_life: float = 78, bound: float = 2.5, eps: float = 1e-8):
        self.rho, self.bound, self.owed, self.count = decay(half_life), bound, 0, 0
        history = np.asarray(history, float)
        self.mean, self.raw = history.mean(axis=0), np.cov(history.T, ddof=1) + eps * np.eye(2)
        self.reg, self.values, self.vectors = floored(self.raw)
        self.distance, self.weight = 0.0, 1.0

    def update(self, x) -> None:
        if x is None or not np.isfinite(x).all():
            self.owed += 1
            return
        rho = self.rho ** (self.owed + 1)
        gap = x - self.mean
        self.distance = math.sqrt(gap @ np.linalg.solve(self.reg, gap))
        self.weight = min(1.0, self.bound / max(self.distance, 1e-12))
        self.mean = rho * self.mean + (1 - rho) * x
        self.raw = rho * self.raw + (1 - rho) * self.weight**2 * np.outer(gap, gap)
        self.reg, self.values, self.vectors = floored(self.raw)
        self.count, self.owed = self.count + 1, 0

    def add_noise(self, noise) -> None:
        """Raise the covariance itself, so that the noise stays in the recursion."""
        self.raw = self.raw + noise
        self.reg, self.values, self.vectors = floored(self.raw)

    def root(self, power: float):
        return (self.vectors * self.values**power) @ self.vectors.T


class Covariance2D:
    """Steps a Huber covariance, seeded by the first known vectors as they come."""

    def __init__(self, history, **how):
        self.cov = HuberCovariance(history, **how)

    def step(self, x, y):
        self.cov.update(None if x is None or y is None else np.array([x, y]))
        c = self.cov
        return float(c.mean[0]), float(c.mean[1]), float(c.raw[0, 0]), float(c.raw[0, 1]), float(c.raw[1, 1]), float(c.values[0]), float(c.values[1]), c.distance, c.weight, c.count, c.owed


class Stress:
    """Velocity and acceleration of the state, each measured by its own covariance."""

    def __init__(self, history, half_life: float = 4, noise_window: int = 520, noise_share: float = 0.1, eps: float = 1e-12):
        self.v_cov, self.a_cov = HuberCovariance(history), HuberCovariance(history)
        self.rho, self.window, self.share, self.eps = decay(half_life), noise_window, noise_share, eps
        self.last, self.velocity, self.owed, self.steps = None, np.zeros(2), 0, []

    def step(self, x, y):
        point = None if x is None or y is None else np.array([x, y])
        if point is None or self.last is None:
            if self.last is not None:
                self.owed += 1
                self.v_cov.update(None)
                self.a_cov.update(None)
            elif point is not None:
                self.last = point
            return (None,) * 5
        rho = self.rho ** (self.owed + 1)
        velocity = rho * self.velocity + (1 - rho) * (point - self.last)
        change = velocity - self.velocity
        self.steps = [*self.steps[-(self.window - 1) :], change]
        self.v_cov.update(velocity)
        self.a_cov.update(change)
        self.a_cov.add_noise(np.diag(np.maximum(np.quantile(np.square(self.steps), self.share, axis=0), self.eps)))
        d = math.sqrt(velocity @ np.linalg.solve(self.v_cov.reg, velocity))
        a = math.sqrt(change @ np.linalg.solve(self.a_cov.reg, change))
        self.last, self.velocity, self.owed = point, velocity, 0
        return float(velocity[0]), float(velocity[1]), d, a, 0.5 * d + 0.5 * a


class Prototypes:
    """Five online cluster centres in the geometry of a running covariance.

    The assigned centre learns; one that was stale for ``stale`` steps first
    gathers four points and then catches up at once.  The others move with the
    mean and covariance, keeping their whitened offsets.
    """

    def __init__(self, history, half_life: float = 78, stale: int = 26, k: int = 5):
        history = np.asarray(history, float)
        bins = np.array_split(history[np.argsort(history[:, 0], kind="stable")], k)
        self.centres, self.mass = np.array([b.mean(axis=0) for b in bins]), np.array([len(b) for b in bins], float)
        _, values, vectors = floored(np.cov(history.T, ddof=1) + 1e-8 * np.eye(2))
        self.offsets = (self.centres - history.mean(axis=0)) @ ((vectors * values**-0.5) @ vectors.T)
        self.rho, self.stale, self.seen, self.waiting = decay(half_life), stale, np.zeros(k, int), [[] for _ in range(k)]

    def update(self, point, t: int, before, cov: HuberCovariance) -> tuple[int, list[float]]:
        """``before`` holds (regularised matrix, square root) of the covariance before the step."""
        reg, root = before
        apart = self.centres - point
        nearest = int(np.argmin(np.einsum("ki,ki->k", apart @ np.linalg.inv(reg), apart)))
        centres = cov.mean + self.offsets @ root
        mass = self.rho * self.mass
        own, gap = self.centres[nearest], max(0, t - self.seen[nearest])
        if gap >= self.stale:
            self.waiting[nearest].append(point)
            learned, start = self.waiting[nearest][-4:], self.rho**gap * self.mass[nearest]
        else:
            learned, start = [point], self.mass[nearest]
        if gap < self.stale or len(learned) == 4:
            for x in learned:
                own, start = (self.rho * start * own + x) / (self.rho * start + 1), self.rho * start + 1
            mass[nearest], self.seen[nearest] = start, t
            if gap >= self.stale:
                self.waiting[nearest] = []
        centres[nearest] = own
        self.centres, self.mass = centres, mass
        self.offsets = (centres - cov.mean) @ cov.root(-0.5)
        apart = centres - point
        score = -0.5 * np.einsum("ki,ki->k", apart @ np.linalg.inv(cov.reg), apart)
        share = np.exp(score - score.max())
        return nearest, (share / share.sum()).tolist()


class SmoothedWeights:
    """Exponentially smoothed lagged weight, from nothing; a rule day leaves it as it is."""

    def __init__(self, half_life: float = 5):
        self.rho, self.value, self.lag = decay(half_life), None, None

    def step(self, weight, is_rule):
        if not is_rule and self.lag is not None:
            self.value = self.rho * (self.value or 0.0) + (1 - self.rho) * self.lag
        out, self.lag = self.value, weight
        return (out,)
