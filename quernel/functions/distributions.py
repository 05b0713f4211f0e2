"""Tail probabilities as native expressions: incomplete beta and gamma functions by continued fractions and series, evaluated step by step over an array of step numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lanczos coefficients for g = 7 and nine terms.
LANCZOS_G = 7.0
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
TINY = 1e-300


def log_gamma(x: Column) -> Column:
    """ln of the gamma function of numbers above 0, to about 14 digits; below a half by the recurrence."""
    y = F.when(x < 0.5, x + 1).otherwise(x) - 1
    total = sum((F.lit(c) / (y + i) for i, c in enumerate(LANCZOS[1:], 1)), F.lit(LANCZOS[0]))
    t = y + LANCZOS_G + 0.5
    whole = 0.5 * math.log(2 * math.pi) + (y + 0.5) * F.log(t) - t + F.log(total)
    return F.when(x < 0.5, whole - F.log(x)).otherwise(whole)


def _apart(x: Column) -> Column:
    """The number, kept away from 0."""
    return F.when(F.abs(x) < TINY, TINY).otherwise(x)


def _steps(n: Column) -> Column:
    return F.sequence(F.lit(1), F.least(n, F.lit(100_000.0)).cast("int"))


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """1 / (1 + e1 / (1 + e2 / (1 + ...))), from the front: c and d are the last two quotients, h is their product so far."""
    real = lambda c: F.lit(c).cast("double")

    def step(s: Column, j: Column) -> Column:
        m = F.floor(j / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        e = F.when(j % 2 == 0, even).otherwise(odd)
        d = 1 / _apart(1 + e * s["d"])
        c = _apart(1 + e / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

    start = F.struct(real(1e300).alias("c"), real(1.0).alias("d"), real(1.0).alias("h"))
    return F.aggregate(_steps(200 + 20 * F.sqrt(F.greatest(a, b))), start, step, lambda s: s["h"])


def beta_tail(x: Column, a: Column, b: Column) -> Column:
    """The regularised incomplete beta function of x in [0, 1]; null for null or impossible arguments."""
    x, a, b = (c.cast("double") for c in (x, a, b))
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b), F.when(swap, 1 - x).otherwise(x)
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + p * F.log(y) + q * F.log1p(-y))
    part = front * _beta_fraction(p, q, y) / p
    inside = F.when(swap, 1 - part).otherwise(part)
    lacking = x.isNull() | a.isNull() | b.isNull() | F.isnan(x) | F.isnan(a) | F.isnan(b)  # least and greatest pass over nulls
    return F.when(lacking | (a <= 0) | (b <= 0) | (x < 0) | (x > 1), None).when(x == 0, 0.0).when(x == 1, 1.0).otherwise(F.least(F.greatest(inside, F.lit(0.0)), F.lit(1.0)))


def gamma_tail(a: Column, x: Column) -> Column:
    """The upper regularised incomplete gamma function; null for null or impossible arguments."""
    a, x = a.cast("double"), x.cast("double")
    front = F.exp(a * F.log(x) - x - log_gamma(a))
    n = 200 + 20 * F.sqrt(a)
    real = lambda c: F.lit(c).cast("double")

    def term(s: Column, j: Column) -> Column:
        t = s["t"] * x / (a + j)
        return F.struct(t.alias("t"), (s["sum"] + t).alias("sum"))

    series = F.aggregate(_steps(n), F.struct((1 / a).alias("t"), (1 / a).alias("sum")), term, lambda s: s["sum"])

    def step(s: Column, j: Column) -> Column:
        e, f = -j * (j - a), x + 2 * j + 1 - a
        d = 1 / _apart(f + e * s["d"])
        c = _apart(f + e / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

    first = 1 / _apart(x + 1 - a)
    fraction = F.aggregate(_steps(n), F.struct(real(1e300).alias("c"), first.alias("d"), first.alias("h")), step, lambda s: s["h"])
    below = x < a + 1
    out = F.when(below, 1 - front * series).otherwise(front * fraction)
    lacking = x.isNull() | a.isNull() | F.isnan(x) | F.isnan(a)
    return F.when(lacking | (a <= 0) | (x < 0), None).when(x == 0, 1.0).otherwise(F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0)))


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation of n pairs, by Student's t with n - 2 degrees of freedom; null below three pairs."""
    return F.when(n > 2, beta_tail(F.greatest(1 - r * r, F.lit(0.0)), (n - 2) / 2, F.lit(0.5)))


def student_p(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t."""
    return beta_tail(df / (df + t * t), df / 2, F.lit(0.5))


def f_p(f: Column, d1: Column, d2: Column) -> Column:
    """Chance of an F of ``f`` or more."""
    return beta_tail(d2 / (d2 + d1 * f), d2 / 2, d1 / 2)


def chi2_p(x: Column, df: Column) -> Column:
    """Chance of a chi-squared of ``x`` or more."""
    return gamma_tail(df / 2, x / 2)
