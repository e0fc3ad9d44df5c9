"""Hash buckets and the two-sample t-test."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# 2^96, 2^64, 2^32 and 1 modulo 100: the weights of the four 32-bit pieces of a 128-bit number.
_WEIGHTS = tuple(pow(2, 32 * (3 - i), 100) for i in range(4))


def md5_mod_100(text: Column) -> Column:
    """The md5 of ``text`` read as one big-endian number, modulo 100, without leaving the JVM."""
    digest = F.md5(text)
    total = F.lit(0).cast("bigint")
    for i, weight in enumerate(_WEIGHTS):
        piece = F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint")
        total = total + F.pmod(piece, F.lit(100)) * weight
    return F.pmod(total, F.lit(100))


def pooled_t(n1: Column, mean1: Column, var1: Column, n2: Column, mean2: Column, var2: Column) -> Column:
    """Student's t with pooled sample variances; infinite for different means without variance, NaN for equal ones."""
    pooled = ((n1 - 1) * var1 + (n2 - 1) * var2) / (n1 + n2 - 2)
    error = F.sqrt(pooled * (F.lit(1.0) / n1 + F.lit(1.0) / n2))
    difference = mean1 - mean2
    flat = F.when(difference == 0, F.lit(float("nan"))).otherwise(F.signum(difference) * F.lit(float("inf")))
    return F.when(error == 0, flat).otherwise(F.try_divide(difference, error))


def _log_gamma_step(a: Column) -> Column:
    """ln of gamma(a + 1/2) / gamma(a): eight steps of the recurrence, then the asymptotic series."""
    far = a + 8
    series = 0.5 * F.log(far) - 1 / (8 * far) + 1 / (192 * far * far * far) - 1 / (640 * F.pow(far, F.lit(5.0)))
    return sum((F.log((a + k) / (a + k + 0.5)) for k in range(8)), series)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta function, by the modified Lentz method over a sequence of as many terms as it takes."""
    def solid(value: Column) -> Column:
        return F.when(value == 0, F.lit(1e-300)).otherwise(value)

    def step(state: Column, j: Column) -> Column:
        m = F.floor((j + 1) / 2).cast("double")
        even = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        term = F.when(j % 2 == 1, m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))).otherwise(even)
        d, c = 1 / solid(1 + term * state["d"]), solid(1 + term / state["c"])
        return F.struct(c.alias("c"), d.alias("d"), (state["value"] * c * d).alias("value"))

    first = 1 / solid(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("value"))
    terms = F.ceil(60 + 8 * F.sqrt(F.greatest(a, b))).cast("int")  # they grow like the root of the larger parameter
    return F.aggregate(F.sequence(F.lit(1), 2 * terms), start, step)["value"]


def t_p_value(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) as the regularised incomplete beta function I_x(df/2, 1/2) at x = df / (df + t^2), as a column expression."""
    square = t * t
    x, rest = df / (df + square), square / (df + square)
    a, b = df / 2, F.lit(0.5)
    front = F.exp(_log_gamma_step(a) - 0.5 * math.log(math.pi) + a * F.log(x) + b * F.log(rest))
    small = x < (a + 1) / (a + b + 2)
    tail = F.when(small, front * _fraction(a, b, x) / a).otherwise(1 - front * _fraction(b, a, rest) / b)
    return F.when(F.isnan(t), F.lit(float("nan"))).when(F.abs(t) == float("inf"), 0.0).when(rest == 0, 1.0).otherwise(tail)
