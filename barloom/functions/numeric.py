"""Numeric expressions Spark has no built-in for."""

from __future__ import annotations

from math import e as EULER
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

from .matrices import cholesky, dot, inverse_of, let, square, times

# Double-precision rational approximation of the normal tail (West 2005).
TAIL_NUMERATOR = (
    0.0352624965998911,
    0.700383064443688,
    6.37396220353165,
    33.912866078383,
    112.079291497871,
    221.213596169931,
    220.206867912376,
)
TAIL_DENOMINATOR = (
    0.0883883476483184,
    1.75566716318264,
    16.064177579207,
    86.7807322029461,
    296.564248779674,
    637.333633378831,
    793.826512519948,
    440.413735824752,
)
TAIL_SWITCH = 7.07106781186547
SQRT_2PI = 2.506628274631
EULER_MASCHERONI = 0.5772156649  # Fixed value


def _poly(coefficients, x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function, JVM-side."""
    a = F.abs(x)
    bell = F.exp(-a * a / 2)
    near = bell * _poly(TAIL_NUMERATOR, a) / _poly(TAIL_DENOMINATOR, a)
    deep = a + 0.65
    for k in (4, 3, 2, 1):
        deep = a + F.lit(float(k)) / deep
    tail = F.when(a > 37, 0.0).when(a < TAIL_SWITCH, near).otherwise(bell / deep / SQRT_2PI)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def two_sided_p(t: Column) -> Column:
    return 2 * (1 - normal_cdf(F.abs(t)))


def expected_max_factor(n_trials: int) -> float:
    """Expected maximum of n independent standard normals, in standard deviations."""
    if n_trials <= 1:
        return 0.0
    inv = NormalDist().inv_cdf
    return (1 - EULER_MASCHERONI) * inv(1 - 1 / n_trials) + EULER_MASCHERONI * inv(1 - 1 / (n_trials * EULER))


def inverse(flat: Column, k: int) -> Column:
    """Inverse of one small symmetric, positive definite matrix per row, as rows; NULL where singular."""
    return let(cholesky(square(flat, k)), inverse_of)


def coefficients(inv: Column, xy: Column) -> Column:
    """inv(X'X) X'y per row."""
    return times(inv, xy)


def sandwich_errors(inv: Column, meat: Column, k: int) -> Column:
    """Square roots of the diagonal of inv * meat * inv per row."""
    return let(square(meat, k), lambda m: F.transform(inv, lambda row: F.sqrt(F.greatest(dot(row, times(m, row)), F.lit(0.0)))))
