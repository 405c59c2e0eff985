"""Tail probabilities that Spark SQL lacks, for one-row-per-column results."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def kolmogorov_tail(statistic: Column, n1: Column, n2: Column) -> Column:
    """Asymptotic two-sided p-value of the two-sample KS statistic, as a built-in fold."""
    z = F.sqrt(n1 * n2 / (n1 + n2)) * statistic
    terms = F.transform(F.sequence(F.lit(1), F.lit(100)),
                        lambda k: F.pow(F.lit(-1.0), k - 1) * F.exp(-2.0 * k * k * z * z))
    total = F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)
    # below z = 0.2 the alternating series has not settled, and the tail is 1 to 12 digits
    return F.when(z < 0.2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * total)))


#: sides up to this size have the exact law of the KS statistic, as the reference call chooses
EXACT_SIDE = 10_000


def exact_ks(statistic: float, n1: int, n2: int) -> float:
    """P(D >= statistic) for two samples of these sizes without ties, by counting lattice paths.

    A path from (0, 0) to (n1, n2) is an order of the pooled sample; D stays below d where |i/n1 - j/n2| < d all along it.
    The number of such paths to (i, j) is the running sum, over the j allowed, of those to (i - 1, j). Each row is scaled
    by its largest number, whose logarithms are added up.
    """
    common = math.gcd(n1, n2)
    a, b = n2 // common, n1 // common  # i/n1 - j/n2 in units of 1/lcm is i a - j b
    gap = round(statistic * n1 * a)
    if gap <= 0:
        return 1.0
    paths, first, scale = np.ones(min(n2, (gap - 1) // b) + 1), 0, 0.0  # row i = 0, from column ``first`` on
    for i in range(1, n1 + 1):
        low = max(0, (i * a - gap) // b + 1)
        high = min(n2, -((-i * a - gap) // b) - 1)
        if low > high:
            return 1.0
        row = np.zeros(high - low + 1)
        kept = paths[low - first:] if low >= first else paths
        row[:len(kept)] = kept[:len(row)]
        row = np.cumsum(row)
        top = row.max()
        if top <= 0:
            return 1.0
        paths, first, scale = row / top, low, scale + math.log(top)
    total = math.lgamma(n1 + n2 + 1) - math.lgamma(n1 + 1) - math.lgamma(n2 + 1)
    inside = math.log(paths[-1]) + scale - total if paths[-1] > 0 else -math.inf
    return min(1.0, max(0.0, -math.expm1(min(inside, 0.0))))


@F.pandas_udf(T.DoubleType())
def _exact_ks(statistic: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(d) or not 0 < max(a, b) <= EXACT_SIDE else exact_ks(d, int(a), int(b))
                      for d, a, b in zip(statistic, n1, n2)], dtype="float64")


def ks_tail(statistic: Column, n1: Column, n2: Column) -> Column:
    """Two-sided p-value of the two-sample statistic: exact while no side has over 10,000 rows, else asymptotic.

    Meant for small results, one value per tested column.
    """
    return F.coalesce(_exact_ks(statistic.cast("double"), n1.cast("double"), n2.cast("double")), kolmogorov_tail(statistic, n1, n2))


def upper_gamma(a: float, x: float) -> float:
    """Regularised Q(a, x): series below a + 1, continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1.0 - total * front)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return min(1.0, front * h)


@F.pandas_udf(T.DoubleType())
def _chi2_tail(statistic: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([
        None if pd.isna(s) or pd.isna(k) else 1.0 if k <= 0 else upper_gamma(k / 2.0, s / 2.0)
        for s, k in zip(statistic, dof)], dtype="float64")


def chi2_tail(statistic: Column, dof: Column) -> Column:
    """Upper tail of the chi-square law; meant for small results, one value per tested column."""
    return _chi2_tail(statistic.cast("double"), dof.cast("double"))


def normal_cdf(x: Column) -> Column:
    """Φ(x) from the complementary error function's Chebyshev fit (relative error below 1.2e-7)."""
    z = F.abs(x) / math.sqrt(2.0)
    t = 1.0 / (1.0 + 0.5 * z)
    # fixed values: coefficients of the published erfc fit, constant term first
    coefficients = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
                    0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    poly = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        poly = poly * t + F.lit(c)
    erfc = t * F.exp(-z * z + poly)
    return F.when(x >= 0, 1.0 - 0.5 * erfc).otherwise(0.5 * erfc)
