"""Diagnostics of symmetric 2x2 covariances in closed form, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The least eigenvalue, and the least one as a share of the largest.
EPS_ABS, EPS_REL = 1e-8, 1e-4
EIGEN_COLUMNS = ("eigval_1", "eigval_2_raw", "eigval_2_reg", "condition_number_raw", "condition_number_reg", "eigval_2_was_floored")


def eigenvalues(a: Column, b: Column, c: Column) -> tuple[Column, Column]:
    """The larger and the smaller eigenvalue of ((a, b), (b, c)).

    The smaller one comes from the determinant, which loses less than the difference
    of two large numbers.
    """
    half, root = (a + c) / 2, F.sqrt((a - c) * (a - c) / 4 + b * b)
    top = half + root
    return top, F.when((half > 0) & (top > 0), (a * c - b * b) / top).otherwise(half - root)


def eigen_diagnostics(df: DataFrame, a: str, b: str, c: str, eps_abs: float = EPS_ABS, eps_rel: float = EPS_REL) -> DataFrame:
    """Add the eigenvalues, raw and floored, condition numbers, the floor's flag and cov_ok.

    A matrix with an eigenvalue below ``-eps_abs`` isn't a covariance: cov_ok is
    false and the other columns are null, as they are for a missing matrix.
    """
    top, low = eigenvalues(F.col(a), F.col(b), F.col(c))
    out = df.withColumns({"_e1": top, "_e2": low})
    fine = (F.col("_e1") >= -eps_abs) & (F.col("_e2") >= -eps_abs)
    first = F.greatest(F.col("_e1"), F.lit(eps_abs))
    least = F.greatest(eps_rel * first, F.lit(eps_abs))
    second = F.greatest(F.col("_e2"), least)
    columns = {
        "eigval_1": first,
        "eigval_2_raw": F.col("_e2"),
        "eigval_2_reg": second,
        "condition_number_raw": first / F.greatest(F.col("_e2"), F.lit(1e-15)),
        "condition_number_reg": first / second,
        "eigval_2_was_floored": F.col("_e2") < least,
    }
    return out.withColumns({name: F.when(fine, c) for name, c in columns.items()} | {"cov_ok": F.coalesce(fine, F.lit(False))}).drop("_e1", "_e2")


def regularised(df: DataFrame, a: str, b: str, c: str, eps_abs: float = EPS_ABS, eps_rel: float = EPS_REL) -> DataFrame:
    """Add reg_a, reg_b, reg_c: the matrix with its eigenvalues floored, its axes kept."""
    top, low = eigenvalues(F.col(a), F.col(b), F.col(c))
    first = F.greatest(top, F.lit(eps_abs))
    second = F.greatest(low, eps_rel * first, F.lit(eps_abs))
    gap = top - low
    # The projection on the larger axis is (m - low) / (top - low); a multiple of one has no axes.
    share = F.when(gap > 0, (first - second) / gap).otherwise(F.lit(0.0))
    shift = second - share * low
    return df.withColumns({"reg_a": share * F.col(a) + shift, "reg_b": share * F.col(b), "reg_c": share * F.col(c) + shift})
