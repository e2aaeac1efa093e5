"""Fixed-point and geometry functions. Lengths are whole numbers of 1/64 point."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT = 64  # fixed value: parts of a point
BIG = "decimal(38,0)"


def half_away(n: Column, d: Column) -> Column:
    """n / d rounded half away from zero, in whole numbers; null over 64 bits or for d = 0."""
    a, b = F.abs(n.cast(BIG)), F.abs(d.cast(BIG))
    sign = F.signum(n).cast("int") * F.signum(d).cast("int")
    q = F.floor((a * 2 + b) / F.nullif(b * 2, F.lit(0).cast(BIG))).cast(BIG) * sign
    return F.when(q.between(F.lit(-(2**63)).cast(BIG), F.lit(2**63 - 1).cast(BIG)), q).try_cast("bigint")


def to_units(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator points in units."""
    return half_away(numerator.cast(BIG) * UNIT, denominator)


def times(a: Column, b: Column) -> Column:
    """The product of two fixed-point numbers."""
    return half_away(a.cast(BIG) * b.cast(BIG), F.lit(UNIT))


def overlap(a_low: Column, a_high: Column, b_low: Column, b_high: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(a_high, b_high) - F.greatest(a_low, b_low))


def distance(a_low: Column, a_high: Column, b_low: Column, b_high: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.greatest(a_low, b_low) - F.least(a_high, b_high))


def aligned(alignment: Column, room: Column, width: Column) -> Column:
    """Where a line of that width begins: start and justify at 0."""
    free = F.greatest(F.lit(0).cast("long"), room - width)
    return F.when(alignment == "center", F.floor(free / 2)).when(alignment == "end", free).otherwise(F.lit(0)).cast("long")


def affine(m: tuple[Column, ...], x: Column, y: Column) -> tuple[Column, Column]:
    """A point under the matrix (a b c d e f)."""
    a, b, c, d, e, f = m
    return a * x + c * y + e, b * x + d * y + f


def compose(m: tuple[Column, ...], n: tuple[Column, ...]) -> tuple[Column, ...]:
    """First m, then n."""
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u
