"""Special functions as column expressions (Spark SQL has no lgamma and no normal distribution function)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients B(2k) / (2k (2k-1)) of the Stirling series.
STIRLING = [1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156]
HALF_LOG_2PI = 0.5 * math.log(2 * math.pi)
SHIFT = 8


def _series(x: Column) -> Column:
    inv = 1.0 / x
    sq = inv * inv
    total = F.lit(STIRLING[-1])
    for coefficient in reversed(STIRLING[:-1]):
        total = total * sq + F.lit(coefficient)
    return total * inv


def stirling_excess(x: Column) -> Column:
    """lgamma(x) - ((x - 1/2) ln x - x + ln(2 pi)/2) for x > 0.

    Small arguments are shifted up first. Differences of lgamma built on this term keep their digits when
    both arguments are large.
    """
    up = x + F.lit(float(SHIFT))
    product = x
    for i in range(1, SHIFT):
        product = product * (x + F.lit(float(i)))
    shifted = (
        _series(up) + (up - 0.5) * F.ln(up) - F.lit(float(SHIFT)) - (x - 0.5) * F.ln(x) - F.ln(product)
    )
    return F.when(x >= 10.0, _series(x)).otherwise(shifted)


def lgamma(x: Column) -> Column:
    """Natural log of the gamma function for x > 0."""
    return (x - 0.5) * F.ln(x) - x + F.lit(HALF_LOG_2PI) + stirling_excess(x)


TAIL_NUMERATOR = [
    220.206867912376, 221.213596169931, 112.079291497871, 33.912866078383,
    6.37396220353165, 0.700383064443688, 0.0352624965998911,
]
TAIL_DENOMINATOR = [
    440.413735824752, 793.826512519948, 637.333633378831, 296.564248779674,
    86.7807322029461, 16.064177579207, 1.75566716318264, 0.0883883476483184,
]


def _polynomial(x: Column, coefficients: list[float]) -> Column:
    total = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        total = total * x + F.lit(c)
    return total


def norm_cdf(x: Column) -> Column:
    """Standard normal distribution function, about 14 digits."""
    size = F.abs(x)
    near = F.exp(-size * size / 2.0) * _polynomial(size, TAIL_NUMERATOR) / _polynomial(size, TAIL_DENOMINATOR)
    fraction = size + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        fraction = size + F.lit(k) / fraction
    far = F.exp(-size * size / 2.0) / fraction / F.lit(math.sqrt(2 * math.pi))
    tail = F.when(size < 7.07106781186547, near).when(size <= 37.0, far).otherwise(F.lit(0.0))
    return F.when(x > 0.0, 1.0 - tail).otherwise(tail)


# Coefficients -B(2k) / (2k) of the digamma series.
DIGAMMA_SERIES = [-1 / 12, 1 / 120, -1 / 252, 1 / 240, -1 / 132, 691 / 32760]
