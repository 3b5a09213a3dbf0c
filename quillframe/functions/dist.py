"""Distribution functions for single statistics (no rows pass through here).

Incomplete beta and gamma functions by their continued fractions and series, as in
the common numerical textbooks.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_EPS = 1e-16
_TINY = 1e-300


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def _beta_fraction(a, b, x):
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > _TINY else _TINY)
    h = d
    for m in range(1, 20000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > _TINY else _TINY)
            c = 1 + num / c
            c = c if abs(c) > _TINY else _TINY
            h *= d * c
        if abs(d * c - 1) < _EPS * 10:
            break
    return h


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        for _ in range(100000):
            k += 1
            term *= x / k
            total += term
            if term < total * _EPS:
                break
        return max(0.0, 1 - total * front)
    b, c = x + 1 - a, 1 / _TINY
    d = 1 / b
    h = d
    for i in range(1, 100000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or _TINY)
        c = b + an / c or _TINY
        h *= d * c
        if abs(d * c - 1) < _EPS * 10:
            break
    return front * h


def norm_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def norm_ppf(p: float) -> float:
    return NormalDist().inv_cdf(p)


def t_two_sided(t: float, dof: float) -> float:
    return beta_inc(dof / 2, 0.5, dof / (dof + t * t))


def f_sf(f: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def chi2_sf(x: float, k: float) -> float:
    return gamma_q(k / 2, x / 2)


def norm_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def t_ppf(p: float, dof: float) -> float:
    """Student-t quantile by bisection on the two-sided tail."""
    if p < 0.5:
        return -t_ppf(1 - p, dof)
    target, lo, hi = 2 * (1 - p), 0.0, 1.0
    while t_two_sided(hi, dof) > target and hi < 1e12:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        if t_two_sided(mid, dof) > target:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def kolmogorov_sf(d: float, n: float) -> float:
    """Asymptotic two-sided Kolmogorov tail with the usual small-sample correction."""
    lam = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * d
    if lam < 0.2:
        return 1.0
    if lam < 1.18:
        y = math.exp(-(math.pi ** 2) / (8 * lam * lam))
        return 1 - math.sqrt(2 * math.pi) / lam * (y + y ** 9 + y ** 25 + y ** 49)
    total = sum((-1) ** (j - 1) * math.exp(-2 * (j * lam) ** 2) for j in range(1, 101))
    return min(max(2 * total, 0.0), 1.0)


def binom_sf(k: int, n: int, p: float) -> float:
    """P(X >= k)."""
    return 1.0 if k <= 0 else 0.0 if k > n else beta_inc(k, n - k + 1, p)


def p_value(fn, *args: Column) -> Column:
    """Apply a scalar function above to a handful of result rows; null in, null out."""

    @F.pandas_udf("double")
    def call(packed: pd.DataFrame) -> pd.Series:
        return pd.Series([None if row.isna().any() else float(fn(*row)) for _, row in packed.iterrows()],
                         dtype="float64")

    return call(F.struct(*[a.cast("double").alias(f"a{i}") for i, a in enumerate(args)]))


# Coefficients of the published double-precision rational approximation
# of the normal distribution function (Hart, as tabulated by West, 2005).
_HART_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
             112.079291497871, 221.213596169931, 220.206867912376)
_HART_BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
                296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def norm_cdf_expr(z: Column) -> Column:
    """Normal distribution function as a column expression (about 15 digits)."""
    a = F.abs(z)

    def poly(coefficients):
        out = F.lit(coefficients[0])
        for c in coefficients[1:]:
            out = out * a + F.lit(c)
        return out

    e = F.exp(-a * a / 2)
    tail = a + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        tail = a + F.lit(k) / tail
    upper = F.when(a > 37, 0.0).when(a < 7.07106781186547, e * poly(_HART_TOP) / poly(_HART_BOTTOM)).otherwise(
        e / tail / 2.506628274631)
    return F.when(z > 0, 1 - upper).otherwise(upper)
