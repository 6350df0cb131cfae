"""Tail probabilities for the t and chi-square tests.

The statistics themselves are computed by Spark aggregations; only the final
p-value of the single result row goes through these scalar functions (via a
pandas UDF). They use the standard continued-fraction / series expansions of
the regularised incomplete beta and gamma functions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import count

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRECISION = 1e-15
NEAR_ZERO = 1e-300


def continued_fraction(parts: Iterator[tuple[float, float]]) -> float:
    """``b0 + a1/(b1 + a2/(b2 + ...))`` from (a0, b0), (a1, b1), ... (a0 unused).

    The ratio of successive convergents is followed through their numerators'
    and denominators' own ratios, until it no longer changes the value. It
    ends by convergence alone; a value that is not a number is returned.
    """
    away = lambda v: NEAR_ZERO if abs(v) <= NEAR_ZERO else v
    _, value = next(parts)
    value = numerators = away(value)
    denominators = 0.0
    for a, b in parts:
        denominators = 1.0 / away(b + a * denominators)
        numerators = away(b + a / numerators)
        change = numerators * denominators
        value *= change
        if not abs(change - 1.0) >= PRECISION:
            return value
    return value


def _beta_parts(a: float, b: float, x: float) -> Iterator[tuple[float, float]]:
    """1 + d1/(1 + d2/(1 + ...)) of the incomplete beta function."""
    yield 0.0, 1.0
    for m in count():
        yield -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0
        k = m + 1
        yield k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)), 1.0


def _gamma_parts(a: float, x: float) -> Iterator[tuple[float, float]]:
    """x + 1 - a - 1(1 - a)/(x + 3 - a - 2(2 - a)/(x + 5 - a - ...))."""
    yield 0.0, x + 1 - a
    for k in count(1):
        yield -k * (k - a), x + 2 * k + 1 - a


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    if x > (a + 1.0) / (a + b + 2.0):  # the fraction converges fast on the other side
        return 1.0 - betainc(b, a, 1.0 - x)
    log_scale = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    return math.exp(log_scale) / (a * continued_fraction(_beta_parts(a, b, x)))


def gammaincc(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x)."""
    if x <= 0.0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x >= a + 1.0:
        return scale / continued_fraction(_gamma_parts(a, x))
    # P(a, x) as a series of x^k / (a (a + 1) ... (a + k))
    term = total = 1.0 / a
    for k in count(1):
        term *= x / (a + k)
        total += term
        if not term >= total * PRECISION:
            return 1.0 - total * scale


def t_two_sided_p(t: float | None, dof: float | None) -> float | None:
    """Two-sided p-value of Student's t with (possibly fractional) dof."""
    if t is None or dof is None or math.isnan(t) or math.isnan(dof) or dof <= 0:
        return None
    if math.isinf(t):
        return 0.0
    return betainc(dof / 2.0, 0.5, dof / (dof + t * t))


def chi2_sf(x: float | None, dof: float | None) -> float | None:
    """Upper tail of the chi-square distribution."""
    if x is None or dof is None or math.isnan(x) or dof <= 0:
        return None
    return gammaincc(dof / 2.0, x / 2.0)


def _none_if_nan(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else v


@F.pandas_udf(T.DoubleType())
def t_pvalue_udf(t: pd.Series, dof: pd.Series) -> pd.Series:
    """Vectorised wrapper; applied to the one aggregated row of a test."""
    return pd.Series([t_two_sided_p(_none_if_nan(a), _none_if_nan(b)) for a, b in zip(t, dof)],
                     dtype="float64")


@F.pandas_udf(T.DoubleType())
def chi2_pvalue_udf(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi2_sf(_none_if_nan(a), _none_if_nan(b)) for a, b in zip(x, dof)],
                     dtype="float64")
