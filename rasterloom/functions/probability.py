"""Distribution functions as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS = 400


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for positive x, by Stirling's series ten steps further on."""
    z = x + 10
    series = F.lit(1.0) / (12 * z) - F.lit(1.0) / (360 * F.pow(z, 3)) + F.lit(1.0) / (1260 * F.pow(z, 5)) - F.lit(1.0) / (1680 * F.pow(z, 7))
    shift = F.lit(0.0)
    for i in range(10):
        shift = shift + F.log(x + i)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - shift


def _once(values: dict[str, Column], of: Callable[[Column], Column]) -> Column:
    """`of` the values, each computed once a row."""
    return F.element_at(F.transform(F.array(F.struct(*(v.alias(k) for k, v in values.items()))), of), 1)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, evaluated from its front (Lentz) until it stays."""
    tiny = F.lit(1e-300)

    def kept(v: Column) -> Column:
        return F.when(F.abs(v) < tiny, tiny).otherwise(v)

    def further(state: Column, j: Column) -> Column:
        m = F.floor(j / 2).cast("double")
        even, odd = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        step = F.when(j % 2 == 0, even).otherwise(odd)
        c, d = kept(1 + step / state["c"]), 1 / kept(1 + step * state["d"])
        new = F.struct(c.alias("c"), d.alias("d"), (state["h"] * c * d).alias("h"), F.abs(c * d - 1).alias("left"))
        return F.when(state["left"] < 1e-16, state).otherwise(new)

    first = F.lit(1.0) / kept(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"), F.lit(1.0).alias("left"))
    return F.aggregate(F.sequence(F.lit(2), F.lit(STEPS)), start, further)["h"]


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function of positive a, b and x in [0, 1]; its fraction is taken on the side where it converges."""

    def value(s: Column) -> Column:
        a, b, x = s["a"], s["b"], s["x"]
        return F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x)) * _fraction(a, b, x) / a

    left = x < (a + 1) / (a + b + 2)
    found = _once({"a": F.when(left, a).otherwise(b), "b": F.when(left, b).otherwise(a), "x": F.when(left, x).otherwise(1 - x)}, value)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(left, found).otherwise(1 - found)


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation r of n pairs (more than two; else null) under independence."""
    free = (n - 2).cast("double")
    return F.when((n > 2) & r.isNotNull(), incomplete_beta(free / 2, F.lit(0.5), F.greatest(F.lit(0.0), 1 - r * r)))
