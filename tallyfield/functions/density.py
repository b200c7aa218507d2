"""Log-densities as Column arithmetic.

Outside the support a density is 0 and its logarithm minus infinity, so sums
over draws or rows stay impossible instead of losing a term.

Spark has no ``lgamma``. ``log_factorial`` therefore uses exact values below
16 and Stirling's series from there on, whose first dropped term is under
2e-14, so there is no lookup table to join and no largest count.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_EXACT = 16


def log_factorial(k: Column) -> Column:
    k = k.cast("double")
    small = F.element_at(F.array(*[F.lit(math.lgamma(i + 1)) for i in range(_EXACT)]), k.cast("int") + 1)
    inv = F.lit(1.0) / k
    inv2 = inv * inv
    series = inv * (1 / 12 - inv2 * (1 / 360 - inv2 * (1 / 1260 - inv2 / 1680)))
    large = k * F.ln(k) - k + 0.5 * F.ln(k * (2 * math.pi)) + series
    return F.when(k.isNull() | (k < 0), F.lit(None).cast("double")).when(k < _EXACT, small).otherwise(large)


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for positive ``x``: Stirling's series ten steps up, taken down again."""
    x = x.cast("double")
    up = x + 10
    inv = F.lit(1.0) / up
    inv2 = inv * inv
    series = inv * (1 / 12 - inv2 * (1 / 360 - inv2 * (1 / 1260 - inv2 / 1680)))
    product = x
    for i in range(1, 10):
        product = product * (x + i)
    return F.when(x > 0, (up - 0.5) * F.ln(up) - up + 0.5 * math.log(2 * math.pi) + series - F.ln(product))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, not at every place that names it."""
    return F.transform(F.array(value), use).getItem(0)


def _beta_fraction(of: Column, steps: int) -> Column:
    """The continued fraction of the incomplete beta function at ``of`` (x, a, b), by Lentz's recurrence."""
    x, a, b = (of.getField(c) for c in "xab")

    def step(held: Column, j: Column) -> Column:
        m = F.floor(j / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))

        def move(term: Column) -> Column:
            c, d = 1 + term / held.getField("c"), 1 / (1 + term * held.getField("d"))
            return F.struct(c.alias("c"), d.alias("d"), (held.getField("h") * c * d).alias("h"))

        return _bound(F.when(j % 2 == 0, even).otherwise(odd), move)

    one = F.lit(1.0)
    start = F.struct(one.alias("c"), F.lit(0.0).alias("d"), one.alias("h"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda held: 1 / held.getField("h"))


def _beta_share(of: Column, steps: int) -> Column:
    """:func:`beta_share` of a bound struct (x, a, b, head), ``head`` the logarithm of what a and b contribute."""
    x, a, b = (of.getField(c) for c in "xab")
    low = x < (a + 1) / (a + b + 2)
    turned = F.when(low, F.struct(x.alias("x"), a.alias("a"), b.alias("b"))).otherwise(
        F.struct((1 - x).alias("x"), b.alias("a"), a.alias("b")))
    head = F.exp(of.getField("head") + a * F.ln(x) + b * F.ln(1 - x))
    part = _bound(turned, lambda t: head * _beta_fraction(t, steps) / t.getField("a"))
    inside = _bound(part, lambda v: F.when(low, v).otherwise(1 - v))
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(inside)


def _beta_of(a: Column, b: Column) -> Column:
    head = log_gamma(a + b) - log_gamma(a) - log_gamma(b)
    return F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"), head.alias("head"))


def _at(x: Column, of: Column) -> Column:
    return F.struct(x.alias("x"), *[of.getField(c).alias(c) for c in ("a", "b", "head")])


def beta_share(x: Column, a: Column, b: Column, steps: int = 200) -> Column:
    """Regularised incomplete beta function, ``x`` between 0 and 1."""
    return _bound(_beta_of(a, b), lambda of: _bound(_at(x, of), lambda s: _beta_share(s, steps)))


def f_quantile(p: float, df1: Column, df2: Column, rounds: int = 50, steps: int = 200) -> Column:
    """The ``p`` quantile of the F distribution, by bisection of its beta form."""

    def quantile(of: Column) -> Column:
        def halve(ends: Column, _: Column) -> Column:
            def turn(middle: Column) -> Column:
                below = _bound(_at(middle, of), lambda s: _beta_share(s, steps)) < p
                return _bound(below, lambda low: F.struct(
                    F.when(low, middle).otherwise(ends.getField("low")).alias("low"),
                    F.when(low, ends.getField("high")).otherwise(middle).alias("high")))

            return _bound((ends.getField("low") + ends.getField("high")) / 2, turn)

        start = F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))
        x = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, halve, lambda ends: (ends.getField("low") + ends.getField("high")) / 2)
        return _bound(x, lambda v: of.getField("b") * v / (of.getField("a") * (1 - v)))

    return _bound(_beta_of(df1 / 2, df2 / 2), quantile)


def times_log(k: Column, x: Column) -> Column:
    """``k ln(x)`` with ``0 ln(0) = 0`` and ``ln(0)`` as minus infinity."""
    return F.when(k == 0, F.lit(0.0)).when(x == 0, _never()).otherwise(k * F.ln(x))


def poisson(y: Column, mu: Column) -> Column:
    return F.when(y < 0, _never()).otherwise(times_log(y, mu) - mu - log_factorial(y))


def binomial(y: Column, n: Column, p: Column) -> Column:
    choose = log_factorial(n) - log_factorial(y) - log_factorial(n - y)
    return F.when((y < 0) | (y > n), _never()).otherwise(choose + times_log(y, p) + times_log(n - y, 1 - p))


def normal(x: Column, mean: Column | float, sd: Column | float) -> Column:
    mean, sd = _lit(mean), _lit(sd)
    z = (x - mean) / sd
    return -0.5 * math.log(2 * math.pi) - F.ln(sd) - 0.5 * z * z


def half_normal(x: Column, sd: float) -> Column:
    """Normal around zero cut to the positive side."""
    return F.when(x >= 0, normal(x, 0.0, sd) + math.log(2)).when(x < 0, _never())


def gamma(x: Column, shape: float, rate: float) -> Column:
    """At 0 the density is infinite, ``rate`` or 0 for a shape below, at or above 1."""
    head = shape * math.log(rate) - math.lgamma(shape)
    at_zero = math.inf if shape < 1 else math.log(rate) if shape == 1 else -math.inf
    inside = F.when(x > 0, head + (shape - 1) * F.ln(x) - rate * x)
    return inside.when(x == 0, F.lit(at_zero)).when(x < 0, _never())


def inverse_gamma(x: Column, shape: float, scale: float) -> Column:
    head = shape * math.log(scale) - math.lgamma(shape)
    return F.when(x > 0, head - (shape + 1) * F.ln(x) - scale / x).when(x <= 0, _never())


def uniform(x: Column, low: float, high: float) -> Column:
    inside = (x >= low) & (x <= high)
    return F.when(inside, F.lit(-math.log(high - low))).when(~inside, _never())


def logit(p: Column) -> Column:
    return F.ln(p / (1 - p))


def inv_logit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _lit(value: Column | float) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def _never() -> Column:
    return F.lit(-math.inf)
