"""Special functions as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY = 1e-300


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x > 0: Stirling's series at x + 8, brought back by the recurrence."""
    y = x + 8
    down = F.lit(0.0)
    for k in range(8):
        down = down + F.ln(x + k)
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5)) - 1 / (1680 * F.pow(y, 7))
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series - down


def _away_from_zero(x: Column) -> Column:
    return F.when(F.abs(x) < _TINY, _TINY).otherwise(x)


def _beta_fraction(x: Column, a: Column, b: Column) -> Column:
    """The continued fraction of the incomplete beta function, evaluated forwards by ratios of its convergents.

    It converges within some multiples of the root of the larger parameter, for x up to (a + 1) / (a + b + 2).
    """
    steps = F.sequence(F.lit(1), (F.lit(60) + 5 * F.sqrt(F.greatest(a, b))).cast("int"))
    d = 1 / _away_from_zero(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("h"))

    def term(state: Column, factor: Column) -> Column:
        d = 1 / _away_from_zero(1 + factor * state["d"])
        c = _away_from_zero(1 + factor / state["c"])
        return F.struct(c.alias("c"), d.alias("d"), (state["h"] * c * d).alias("h"))

    def even(state: Column, m: Column) -> Column:
        return term(state, m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)))

    def odd(state: Column, m: Column) -> Column:
        return term(state, -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))

    # two folds in one: each number stands for an even and an odd term
    twice = F.flatten(F.transform(steps, lambda m: F.array(m, -m)))
    return F.aggregate(twice, start, lambda s, m: F.when(m > 0, even(s, m)).otherwise(odd(s, -m)), lambda s: s["h"])


def incomplete_beta(x: Column, a: Column, b: Column) -> Column:
    """The regularised incomplete beta function I_x(a, b), 0 <= x <= 1, a and b > 0."""
    inner = F.greatest(F.least(x, F.lit(1 - 1e-16)), F.lit(_TINY))
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(inner) + b * F.ln(1 - inner))
    low = front * _beta_fraction(inner, a, b) / a
    high = 1 - front * _beta_fraction(1 - inner, b, a) / b
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(inner < (a + 1) / (a + b + 2), low).otherwise(high)


def student_p(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t with `df` degrees of freedom; null where either is null."""
    return F.when(t.isNotNull() & (df > 0), incomplete_beta(df / (df + t * t), df / 2, F.lit(0.5)))
