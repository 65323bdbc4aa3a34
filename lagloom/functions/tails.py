"""Tail probabilities that Spark SQL lacks, as column expressions.

The normal tail is a series below 1.5 and a continued fraction above; Student's
and the fair coin's are the incomplete beta function's continued fraction. All
are evaluated from the last term backwards in ``aggregate``, a fixed number of
steps that settles them to about 1e-13 of their value, so no value leaves the
JVM.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of the series and of the fractions.
SERIES, FRACTION, BETA = 30, 80, 60
#: Bernoulli's terms of ln Gamma, and of ln (Gamma(z + 1/2) / Gamma(z)).
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156)
HALF_STEP = (-1 / 8, 1 / 192, -1 / 640, 17 / 14336, -31 / 18432)


def _named(f: Callable, **values: Column) -> Column:
    """f of a struct of the values, each computed once."""
    return F.transform(F.array(F.struct(*(v.cast("double").alias(k) for k, v in values.items()))), f)[0]


def _down(steps: int | Column, start: Column, f: Callable) -> Column:
    """f(f(start, steps), steps - 1) and so on to 1."""
    return F.aggregate(F.sequence(steps if isinstance(steps, Column) else F.lit(steps), F.lit(1), F.lit(-1)), start, f)


def erfc(z: Column) -> Column:
    """Of z from 0 on."""

    def of(s):
        x = s["z"]
        short = 1 - 2 / math.sqrt(math.pi) * F.exp(-x * x) * x * _down(SERIES, F.lit(1.0), lambda t, n: 1 + t * 2 * x * x / (2 * n + 1))
        far = F.exp(-x * x) / math.sqrt(math.pi) / _down(FRACTION, x, lambda t, n: x + n / 2 / t)
        return F.when(x < 1.5, short).when(x >= 1.5, far)

    return _named(of, z=z)


def normal_p(z: Column) -> Column:
    """Two-sided."""
    return erfc(F.abs(z) / math.sqrt(2))


def _series(z: Column, terms: tuple) -> Column:
    """terms[0] / z + terms[1] / z^3 + ..."""
    total = F.lit(0.0)
    for t in reversed(terms):
        total = total / (z * z) + t
    return total / z


def ln_gamma(x: Column) -> Column:
    """Of x above 0, from eight further on."""

    def of(s):
        z, low = s["x"] + 8, F.lit(1.0)
        for k in range(8):
            low = low * (s["x"] + k)
        return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + _series(z, STIRLING) - F.ln(low)

    return _named(of, x=x)


def ln_half_step(x: Column) -> Column:
    """ln (Gamma(x + 1/2) / Gamma(x)), without the difference of two large
    numbers."""

    def of(s):
        z, low = s["x"] + 12, F.lit(1.0)
        for k in range(12):
            low = low * (s["x"] + k) / (s["x"] + k + 0.5)
        return 0.5 * F.ln(z) + _series(z, HALF_STEP) + F.ln(low)

    return _named(of, x=x)


def _beta_share(a: Column, b: Column, x: Column, y: Column, ln_factor: Column, steps: int | Column = BETA) -> Column:
    """The regularised incomplete beta function of x = 1 - y; ln_factor:
    ln (Gamma(a + b) / Gamma(a) / Gamma(b))."""

    def fraction(s):
        a, b, x = s["a"], s["b"], s["x"]

        def step(f, k):
            f = 1 - (a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1)) / f
            return 1 + k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)) / f

        whole = 1 - (a + b) * x / (a + 1) / _down(steps, F.lit(1.0), step)
        ln_x = F.when(s["y"] < 0.5, F.log1p(-s["y"])).otherwise(F.ln(x))
        ln_y = F.when(x < 0.5, F.log1p(-x)).otherwise(F.ln(s["y"]))
        part = F.when(x > 0, F.exp(s["c"] + a * ln_x + b * ln_y) / a / whole).otherwise(0.0)
        return F.when(s["turned"] == 1, 1 - part).otherwise(part)

    turned = x > (a + 1) / (a + b + 2)
    pick = lambda u, v: F.when(turned, v).otherwise(u)
    return _named(fraction, a=pick(a, b), b=pick(b, a), x=pick(x, y), y=pick(y, x), c=ln_factor, turned=turned.cast("int"))


def student_p(t: Column, df: Column) -> Column:
    """Two-sided."""

    def of(s):
        t2, df = s["t"] * s["t"], s["df"]
        factor = ln_half_step(df / 2) - 0.5 * math.log(math.pi)
        p = _beta_share(df / 2, F.lit(0.5), df / (df + t2), t2 / (df + t2), factor)
        return F.when(F.abs(s["t"]) == float("inf"), 0.0).when(t2.isNotNull() & df.isNotNull(), p)

    return _named(of, t=t, df=df)


def coin_p(k: Column, n: Column) -> Column:
    """P(at least k heads of n)."""

    def of(s):
        a, b = s["k"], s["n"] - s["k"] + 1
        factor = ln_gamma(s["n"] + 1) - ln_gamma(a) - ln_gamma(b)
        p = _beta_share(a, b, F.lit(0.5), F.lit(0.5), factor, (BETA + F.ceil(F.sqrt(s["n"]))).cast("int"))
        return F.when(s["k"] <= 0, 1.0).when(s["k"] > s["n"], 0.0).when(s["k"].isNotNull() & s["n"].isNotNull(), F.least(p, F.lit(1.0)))

    return _named(of, k=k, n=n)


def fisher_z(r: Column, n: Column, k: Column) -> Column:
    """sqrt(n - k - 3) |atanh r|; null where p is 0 or 1 by definition."""
    dof = n - k - 3
    return F.when((dof >= 1) & (F.abs(r) < 1), F.abs(F.atanh(r)) * F.sqrt(F.greatest(dof, F.lit(0)).cast("double")))


def fisher_p(r: Column, n: Column, k: Column) -> Column:
    edge = F.when(F.abs(r) < 1, 1.0).otherwise(0.0)
    return F.coalesce(normal_p(fisher_z(r, n, k)), edge)
