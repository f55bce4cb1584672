"""Small numeric expressions: safe ratios, bias corrections, test p-values."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, NULL when b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def percent(a: Column, b: Column) -> Column:
    return ratio(a, b) * 100.0


def at_least(value: Column, floor: float) -> Column:
    return F.greatest(value, F.lit(float(floor)))


def tidy(value: Column, digits: int = 6) -> Column:
    """Rounded, with negative zero folded into zero."""
    return F.round(value, digits) + F.lit(0.0)


def corrected_skew(n: Column, g1: Column) -> Column:
    """Bias-corrected sample skewness from the population one."""
    n = n.cast("double")
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def corrected_kurtosis(n: Column, g2: Column) -> Column:
    """Bias-corrected sample excess kurtosis from the population one."""
    n = n.cast("double")
    body = F.try_divide((n - 1) * ((n + 1) * g2 + 6), (n - 2) * (n - 3))
    return F.when(n > 3, body)


def normality_p(n: Column, g1: Column, g2: Column) -> Column:
    """p-value of the K-squared omnibus test (D'Agostino 1970, Anscombe-Glynn 1983).

    Two degrees of freedom, so the chi-square tail is a plain exponential.
    NULL for 8 rows or fewer.
    """
    n = F.when(n > 8, n.cast("double"))
    b = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (b - 1)) - 1
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    z_skew = F.asinh(y / F.sqrt(2 / (w2 - 1))) / F.sqrt(0.5 * F.log(w2))

    mean = 3 * (n - 1) / (n + 1)
    spread = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (g2 + 3 - mean) / F.sqrt(spread)
    root = F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    s = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * root
    a = 6 + (8 / s) * (2 / s + F.sqrt(1 + 4 / (s * s)))
    q = 1 + x * F.sqrt(2 / (a - 4))
    cube = F.signum(q) * F.cbrt(F.try_divide(1 - 2 / a, F.abs(q)))
    z_kurt = (1 - 2 / (9 * a) - cube) / F.sqrt(2 / (9 * a))
    return F.exp(-(z_skew * z_skew + z_kurt * z_kurt) / 2)


def kolmogorov_p(d: Column, n: Column, m: Column | None = None) -> Column:
    """Asymptotic p-value of a KS distance; one sample of size n, or two of n and m."""
    n = n.cast("double")
    size = n if m is None else ratio(n * m.cast("double"), n + m.cast("double"))
    e = F.sqrt(size)
    lam = (e + 0.12 + F.try_divide(F.lit(0.11), e)) * d
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * lam * lam),
    )
    # below 0.2 the series has not converged and the exact value is 1 to ten digits
    return F.when(lam < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2.0 * series)))


def _chi_square_tail(x: float, dof: float) -> float:
    """Upper tail of chi-square: regularised incomplete gamma Q(dof/2, x/2)."""
    if x is None or dof is None or math.isnan(x) or math.isnan(dof) or dof <= 0:
        return float("nan")
    a, z = dof / 2.0, x / 2.0
    if z <= 0:
        return 1.0
    front = math.exp(a * math.log(z) - z - math.lgamma(a))
    if z < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= z / k
            total += term
        return max(0.0, 1.0 - front * total)
    # Legendre continued fraction, evaluated with the modified Lentz method
    tiny = 1e-300
    b = z + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return min(1.0, front * h)


@F.pandas_udf(T.DoubleType())
def chi_square_p(x: pd.Series, dof: pd.Series) -> pd.Series:
    """Runs on one row per column, never on base rows."""
    return pd.Series([_chi_square_tail(a, b) for a, b in zip(x, dof)])


def severity(score: Column) -> Column:
    """Drift severity from a score. 0.3, 0.2, 0.1, 0.05."""
    return (F.when(score >= 0.3, "critical").when(score >= 0.2, "high")
            .when(score >= 0.1, "medium").when(score >= 0.05, "low").otherwise("none"))
