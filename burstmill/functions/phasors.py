"""Complex samples as two real columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keeps the power of an empty window from dividing by zero; it stands under the root.
EPSILON = 1e-12


def amplitude(i: Column, q: Column) -> Column:
    return F.sqrt(i * i + q * q)


def decibel(a: Column) -> Column:
    """Ten times the logarithm of the amplitude (not twenty); null unless a > 0."""
    return F.when(a > 0, 10 * F.log10(a))


def parts(i1: Column, q1: Column, i2: Column, q2: Column) -> dict[str, Column]:
    """The four products that coherence sums over its window: s1 times conjugate s2, and both powers."""
    return {"re": i1 * i2 + q1 * q2, "im": q1 * i2 - i1 * q2, "p1": i1 * i1 + q1 * q1, "p2": i2 * i2 + q2 * q2}


def coherence(re: Column, im: Column, p1: Column, p2: Column) -> Column:
    root = F.sqrt(p1 * p2 + EPSILON)
    return F.sqrt((re / root) * (re / root) + (im / root) * (im / root))


def phase(re: Column, im: Column) -> Column:
    return F.atan2(im, re)


def wrapped(angle: Column) -> Column:
    """angle brought to -pi..pi."""
    return F.atan2(F.sin(angle), F.cos(angle))


def no_nan(x: Column) -> Column:
    """NaN is no data: null."""
    return F.when(~F.isnan(x), x)
