"""Null-safe column arithmetic and the two distribution tails Spark SQL lacks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Upper 5 % point of the standard normal distribution (fixed value).
Z_UPPER_5_PERCENT = 1.6448536269514722


def ratio(num, den) -> Column:
    """num / den as double, NULL when the denominator is zero or missing."""
    return F.try_divide(_col(num).cast("double"), _col(den).cast("double"))


def share(condition: Column) -> Column:
    """Aggregate: fraction of rows for which the condition holds."""
    return F.avg(condition.cast("double"))


def count_where(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def finite_or_null(value) -> Column:
    """Infinite and NaN values become NULL."""
    v = _col(value)
    return F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)


def is_infinite(value) -> Column:
    return F.abs(_col(value)) == F.lit(float("inf"))


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _erfc(x: np.ndarray) -> np.ndarray:
    """Complementary error function: power series near zero, continued fraction beyond, whole columns at once."""
    a = np.abs(x)
    near = np.where(a < 2.0, a, 0.0)
    term, total = near.copy(), near.copy()
    for n in range(1, 60):
        term = -term * near * near / n
        total = total + term / (2 * n + 1)
    far = np.where(a < 2.0, 2.0, np.minimum(a, 40.0))
    tail = np.zeros_like(far)
    for n in range(200, 0, -1):
        tail = (n / 2) / (far + tail)
    outer = np.exp(-far * far) / (math.sqrt(math.pi) * (far + tail))
    upper = np.where(a < 2.0, 1 - 2 / math.sqrt(math.pi) * total, outer)
    return np.where(x < 0, 2 - upper, upper)


@F.pandas_udf(T.DoubleType())
def normal_upper_tail(z: pd.Series) -> pd.Series:
    """1 - Phi(z); only ever applied to one value per scored row."""
    x = z.to_numpy(dtype=float, na_value=np.nan) / math.sqrt(2)
    return pd.Series(np.where(np.isnan(x), None, 0.5 * _erfc(x)), dtype="float64")


def _beta_fraction(a: float, b: float, x: float) -> float:
    # Lentz evaluation of the continued fraction of the incomplete beta function.
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-16:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


@F.pandas_udf(T.DoubleType())
def correlation_two_tail_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-tail p-value of a correlation r over n pairs (t-test with n - 2 degrees of freedom)."""

    def tail(rv, nv):
        if rv is None or nv is None or math.isnan(rv) or math.isnan(nv) or nv < 3:
            return None
        if abs(rv) >= 1.0:
            return 0.0
        # t^2 = r^2 df / (1 - r^2), hence df / (df + t^2) = 1 - r^2.
        return incomplete_beta((nv - 2) / 2.0, 0.5, 1.0 - rv * rv)

    return pd.Series([tail(a, b) for a, b in zip(r, n)], dtype="float64")


def one_tail_p(r: Column, two_tail: Column, alternative: str) -> Column:
    """One-tail p-value from the two-tail one; alternative is greater, less or different."""
    if alternative == "different":
        return two_tail
    agrees = (r > 0) if alternative == "greater" else (r < 0)
    return F.when(agrees, two_tail / 2).otherwise(1 - two_tail / 2)


@F.pandas_udf(T.StructType([T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType())]))
def strict_reach(p: pd.Series, delta: pd.Series) -> pd.DataFrame:
    """Smallest and largest double whose floating distance to p is strictly below delta.

    Comparing with ``p - delta`` and ``p + delta`` is off by one rounding at the border;
    bisection on doubles gives the bounds that reproduce ``abs(q - p) < delta`` exactly.
    """
    centre, width = p.to_numpy(float), delta.to_numpy(float)

    def bound(sign):
        inside = centre.copy()
        outside = centre + sign * width * 1.000001 + sign * 1e-300
        for _ in range(1100):
            mid = inside + (outside - inside) / 2
            stuck = (mid == inside) | (mid == outside)
            if stuck.all():
                break
            ok = np.abs(mid - centre) < width
            inside = np.where(ok & ~stuck, mid, inside)
            outside = np.where(~ok & ~stuck, mid, outside)
        return inside

    return pd.DataFrame({"lo": bound(-1.0), "hi": bound(1.0)})
