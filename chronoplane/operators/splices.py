"""Series from several sources: precedence with agreement on overlaps, and regression onto longer series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_precedence(observations: DataFrame, keys: list[str], source: str, value: str, ranking: list[str], tolerance: float = 1e-8) -> DataFrame:
    """One value per key from the first source of ``ranking`` that knows it.

    Adds n_sources, max_abs_diff (of the others from the chosen value; null without
    another) and status: ``conflict`` where a source differs by more than
    ``tolerance``, else ``ok``.  A conflicting key keeps its row, so nothing is
    silently merged or lost.  Unknown sources rank last, by name; of repeated rows
    of a source the largest value counts.
    """
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, ranking)), F.col(source)), F.lit(0))
    known = observations.where(F.col(value).isNotNull())
    one = known.groupBy(*keys, source).agg(F.max(value).alias("v")).withColumn("_r", F.when(rank > 0, rank).otherwise(len(ranking) + 1))
    chosen = one.groupBy(*keys).agg(F.min_by(F.struct("v", F.col(source).alias("s")), F.struct("_r", source)).alias("c"), F.min("v").alias("_lo"), F.max("v").alias("_hi"), F.count(F.lit(1)).alias("n_sources"))
    off = F.when(F.col("n_sources") > 1, F.greatest(F.col("c.v") - F.col("_lo"), F.col("_hi") - F.col("c.v")))
    out = chosen.select(*keys, F.col("c.v").alias(value), F.col("c.s").alias(source), "n_sources", off.alias("max_abs_diff"))
    return out.withColumn("status", F.when(F.col("max_abs_diff") > tolerance, "conflict").otherwise("ok"))


def overlap_checks(observations: DataFrame, by: str, keys: list[str], source: str, value: str, ranking: list[str], tolerance: float = 1e-8) -> DataFrame:
    """Per key of ``by`` and each source after the first: rows it shares with a better one, and how far they differ.

    A source without a shared row has one all the same: 0 rows, status ``ok``.
    """
    known = observations.where(F.col(value).isNotNull()).groupBy(by, *keys, source).agg(F.max(value).alias("v"))
    best = known.groupBy(by, *keys).agg(F.min_by("v", F.array_position(F.array(*map(F.lit, ranking)), F.col(source))).alias("best"), F.min(F.array_position(F.array(*map(F.lit, ranking)), F.col(source))).alias("_r"))
    rank = F.array_position(F.array(*map(F.lit, ranking)), F.col(source))
    shared = known.withColumn("rank", rank).join(best, [by, *keys]).withColumn("off", F.when(F.col("rank") > F.col("_r"), F.abs(F.col("v") - F.col("best"))))
    sums = shared.groupBy(by, source).agg(F.count("off").alias("overlap_rows"), F.max("off").alias("max_abs_diff"))
    checked = sums.where(F.col(source) != ranking[0])
    return checked.withColumn("tolerance", F.lit(tolerance)).withColumn("status", F.when(F.col("max_abs_diff") > tolerance, "conflict").otherwise("ok"))


def _solved(p: int) -> list[tuple[str, Column]]:
    """Columns that solve the normal equations of width p from covariances s*_* and s*_y, by a Cholesky factor.

    A regressor that the ones before it determine has no slope of its own: 0.
    """
    out: list[tuple[str, Column]] = []
    for j in range(p):
        rest = F.col(f"s{j}_{j}")
        for k in range(j):
            rest = rest - F.col(f"l{j}_{k}") * F.col(f"l{j}_{k}")
        out.append((f"l{j}_{j}", F.when(rest > 1e-12 * F.col(f"s{j}_{j}"), F.sqrt(rest))))
        for i in range(j + 1, p):
            cross = F.col(f"s{j}_{i}")
            for k in range(j):
                cross = cross - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
            out.append((f"l{i}_{j}", F.coalesce(cross / F.col(f"l{j}_{j}"), F.lit(0.0))))
    for j in range(p):
        z = F.col(f"s{j}_y")
        for k in range(j):
            z = z - F.col(f"l{j}_{k}") * F.col(f"z{k}")
        out.append((f"z{j}", F.coalesce(z / F.col(f"l{j}_{j}"), F.lit(0.0))))
    for j in reversed(range(p)):
        b = F.col(f"z{j}")
        for k in range(j + 1, p):
            b = b - F.col(f"l{k}_{j}") * F.col(f"b{k}")
        out.append((f"b{j}", F.coalesce(b / F.col(f"l{j}_{j}"), F.lit(0.0))))
    return out


def fit_ols(df: DataFrame, by: str, y: str, xs: list[str]) -> DataFrame:
    """Least squares of y on any number of regressors and a constant: (by, n, slopes, intercept, r2).

    Rows count where all are known.  The covariances are one aggregation with
    partial sums; a row per key is solved in columns.
    """
    p = len(xs)
    known = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [y, *xs]))
    moments = [F.covar_pop(xs[i], xs[j]).alias(f"s{i}_{j}") for i in range(p) for j in range(i, p)] + [F.covar_pop(x, y).alias(f"s{i}_y") for i, x in enumerate(xs)]
    sums = known.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.var_pop(y).alias("_yy"), F.avg(y).alias("_my"), *[F.avg(x).alias(f"_m{i}") for i, x in enumerate(xs)], *moments)
    for name, c in _solved(p):
        sums = sums.withColumn(name, c)
    fitted = sum((F.col(f"b{i}") * F.col(f"s{i}_y") for i in range(p)), F.lit(0.0))
    level = F.col("_my") - sum((F.col(f"b{i}") * F.col(f"_m{i}") for i in range(p)), F.lit(0.0))
    return sums.select(by, "n", F.array(*[f"b{i}" for i in range(p)]).alias("slopes"), level.alias("intercept"), F.coalesce(fitted / F.when(F.col("_yy") > 0, F.col("_yy")), F.lit(0.0)).alias("r2"))


def ols_splice(df: DataFrame, by: str, order: str, y: str, xs: list[str], low: float, high: float) -> DataFrame:
    """A short series continued backwards by regression on longer ones.

    The fit is on rows where all are known; a key with fewer than 2 * (regressors + 1)
    of them is fitted on the first regressor alone.  Rows before the key's first
    known y are predicted, within ``low`` and ``high``, where the regressors used are
    known; a key without any y has none.  Returns (by, order, y, origin) of the
    predicted and the observed rows.
    """
    full, short = fit_ols(df, by, y, xs), fit_ols(df, by, y, xs[:1])
    enough = F.col("n") >= 2 * (len(xs) + 1)
    none = F.array(*[F.lit(0.0)] * (len(xs) - 1))
    chosen = short.select(by, F.col("intercept").alias("_i1"), F.concat("slopes", none).alias("_s1")).join(full, by, "left")
    chosen = chosen.select(by, F.coalesce(enough, F.lit(False)).alias("_wide"), F.when(enough, F.col("intercept")).otherwise(F.col("_i1")).alias("_i"), F.when(enough, F.col("slopes")).otherwise(F.col("_s1")).alias("_b"))
    first = df.where(F.col(y).isNotNull()).groupBy(by).agg(F.min(order).alias("_first"))
    # Two rows per key; the long table isn't shuffled for them where they are small.
    met = df.join(chosen.join(first, by), by)
    terms = [F.col(xs[0]) * F.get("_b", F.lit(0))]
    terms += [F.when(F.col("_wide"), F.col(x) * F.get("_b", F.lit(i))).otherwise(F.lit(0.0)) for i, x in enumerate(xs) if i]
    guess = sum(terms, F.col("_i"))
    bounded = F.when(guess.isNotNull() & ~F.isnan(guess) & (F.abs(guess) < float("inf")), F.greatest(F.lit(low), F.least(F.lit(high), guess)))
    value = F.when(F.col(order) < F.col("_first"), bounded).otherwise(F.col(y).cast("double"))
    out = met.select(by, order, value.alias(y), F.when(F.col(order) < F.col("_first"), "predicted").otherwise("observed").alias("origin"))
    return out.where(F.col(y).isNotNull())
