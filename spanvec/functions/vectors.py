"""Vector arithmetic as Spark expressions over array<double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HALF_MAX = 65504.0


def doubles(c: Column) -> Column:
    return c.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def normalize(a: Column) -> Column:
    """a over its length; a zero vector is an error."""
    n = norm(a)
    checked = F.when(n > 0, n).otherwise(F.raise_error(F.lit("a zero vector can't be normalised")).cast("double"))
    # array_repeat evaluates the length once a row, not once an element
    return F.zip_with(a, F.array_repeat(checked, F.size(a)), lambda x, m: x / m)


def half(x: Column) -> Column:
    """x as the nearest IEEE half, ties to even; infinite beyond the largest."""
    scale = F.pow(F.lit(2.0), 10 - F.greatest(F.floor(F.log2(F.abs(x))), F.lit(-14)))
    r = F.rint(x * scale) / scale
    return F.when(x == 0, x).when(F.abs(r) > HALF_MAX, F.signum(x) * F.lit(float("inf"))).otherwise(r)


def half_vector(a: Column) -> Column:
    return F.transform(a, half)


def half_bits(b: Column) -> Column:
    """The double that 16 bits of a half stand for."""
    sign = F.when(F.shiftright(b, 15).bitwiseAND(F.lit(1)) == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
    e, m = F.shiftright(b, 10).bitwiseAND(F.lit(31)), b.bitwiseAND(F.lit(1023))
    return (
        F.when(e == 0, sign * m * F.pow(F.lit(2.0), F.lit(-24)))
        .when((e == 31) & (m == 0), sign * F.lit(float("inf")))
        .when(e == 31, F.lit(float("nan")))
        .otherwise(sign * (1 + m / 1024) * F.pow(F.lit(2.0), e - 15))
    )
