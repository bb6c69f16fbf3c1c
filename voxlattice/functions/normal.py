"""The standard normal distribution as Catalyst expressions, so that p-values stay in generated code.

The tail uses the ten-coefficient Chebyshev fit of erfc (relative error below 1.2e-7), the quantile a rational
approximation (relative error below 1.2e-9). Both are published fits; on the driver statistics.NormalDist is used.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# erfc(z) = t exp(-z z + P(t)), t = 1 / (1 + z / 2), coefficients of P from low to high.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)

# Rational fits of the normal quantile, numerators and denominators from high to low.
CENTRE_NUMERATOR = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
CENTRE_DENOMINATOR = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
TAIL_NUMERATOR = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
TAIL_DENOMINATOR = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
TAIL_BELOW = 0.02425

TINY = 2.2250738585072014e-308


def _polynomial(x: Column, high_to_low: tuple[float, ...]) -> Column:
    out = F.lit(high_to_low[0])
    for c in high_to_low[1:]:
        out = out * x + F.lit(c)
    return out


def upper_tail(x: Column) -> Column:
    """P(Z > x)."""
    z = F.abs(x) / math.sqrt(2)
    t = F.lit(1.0) / (F.lit(1.0) + z * 0.5)
    half = t * F.exp(-z * z + _polynomial(t, ERFC[::-1])) * 0.5
    return F.when(x >= 0, half).otherwise(F.lit(1.0) - half)


def upper_quantile(p: Column) -> Column:
    """The x with P(Z > x) = p, for 0 < p < 1."""
    lower = F.least(p, F.lit(1.0) - p)
    q = F.sqrt(F.log(lower) * -2.0)
    tail = -_polynomial(q, TAIL_NUMERATOR) / _polynomial(q, TAIL_DENOMINATOR)
    c = F.lit(0.5) - p
    r = c * c
    centre = c * _polynomial(r, CENTRE_NUMERATOR) / _polynomial(r, CENTRE_DENOMINATOR)
    return F.when(lower < TAIL_BELOW, F.when(p < 0.5, tail).otherwise(-tail)).otherwise(centre)


def signed_z(p_two_sided: Column, direction: Column) -> Column:
    """The z-value of a two-sided p-value with the sign of `direction`; p is clipped to [TINY, 1]."""
    p = F.greatest(F.lit(TINY), F.least(F.lit(1.0), p_two_sided))
    return F.signum(direction) * F.when(p >= 1, F.lit(0.0)).otherwise(upper_quantile(p / 2))


def critical_value(alpha: float) -> float:
    """The upper quantile of alpha on the driver."""
    return -NormalDist().inv_cdf(alpha)


def upper_tail_sql(x: str) -> str:
    """upper_tail() as SQL text, for checks in another engine."""
    z, t = f"(abs({x}) / sqrt(2e0))", f"(1e0 / (1e0 + abs({x}) / sqrt(2e0) * 0.5e0))"
    poly = repr(ERFC[-1])
    for c in ERFC[-2::-1]:
        poly = f"({poly}::DOUBLE * {t} + {c!r}::DOUBLE)"
    half = f"({t} * exp(-{z} * {z} + {poly}) * 0.5e0)"
    return f"(CASE WHEN {x} >= 0 THEN {half} ELSE 1e0 - {half} END)"
