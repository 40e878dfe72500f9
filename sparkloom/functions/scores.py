"""Column functions for scores, times and intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unified_score(distance: Column) -> Column:
    """A cosine distance as a score in 0..1."""
    return F.round(F.greatest(F.lit(0.0), 1 - distance / 2), 4)


def clamped(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def freshness(age_hours: Column, most: float, half_life: float) -> Column:
    """1 up to most hours, then halved every half_life hours."""
    return F.when(age_hours <= most, F.lit(1.0)).otherwise(F.pow(F.lit(0.5), (age_hours - most) / half_life))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper bound of a share."""
    p, zz = hits / n, z * z
    centre, spread = p + zz / (2 * n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    return (centre - spread) / (1 + zz / n), (centre + spread) / (1 + zz / n)


def band(x: Column, low: float = 0.34, high: float = 0.67) -> Column:
    return F.when(x < low, "low").when(x < high, "medium").otherwise("high")


def quiet(ts: Column, start: int = 22, end: int = 7) -> Column:
    """Whether a time lies in the quiet hours, which may span midnight."""
    h = F.hour(ts)
    return ((h >= start) | (h < end)) if start > end else ((h >= start) & (h < end))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays, in double."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
