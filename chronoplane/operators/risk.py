"""State weight, risk score and their routing into buckets and gates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the five states, fixed values.
STATE_WEIGHTS = (1.0, 0.7, 0.3, 0.6, 0.9)


def unit(x: Column) -> Column:
    """x within 0 and 1; unknown stays unknown."""
    return F.when(x.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def state_weight(p: Column, drift: Column, low: float = 1.2, high: float = 1.8, neutral: float = 0.6) -> Column:
    """Expected state weight, moved to neutral as drift grows from low to high."""
    own = F.aggregate(F.zip_with(p, F.array(*[F.lit(w) for w in STATE_WEIGHTS]), lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    ramp = unit((F.abs(drift) - low) / (high - low))
    return (1 - ramp) * own + ramp * neutral


def risk_score(weight: Column, stress: Column, lead: Column, amplify: float = 0.75) -> Column:
    fragility = unit(2 * F.greatest(lead - 0.5, F.lit(0.0)))
    return unit(1 - (1 - unit(weight * stress)) * (1 - amplify * fragility))


def bucket(x: Column, bounds: list[float]) -> Column:
    """Number of the half-open interval that holds x; the last one is closed."""
    out = F.when(x.isNull() | (x < bounds[0]) | (x > bounds[-1]), F.lit(None).cast("int"))
    for i, high in enumerate(bounds[1:-1]):
        out = out.when(x < high, F.lit(i))
    return out.otherwise(F.lit(len(bounds) - 2))


def normal_tail(z: Column) -> Column:
    """Two-sided tail of the normal distribution, by a rational approximation (1.5e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def chi2_tail_even(x: Column, df: int) -> Column:
    """Upper tail of the chi-square distribution for an even number of degrees."""
    term, total = F.lit(1.0), F.lit(1.0)
    for i in range(1, df // 2):
        term = term * x / 2 / i
        total = total + term
    return F.exp(-x / 2) * total
