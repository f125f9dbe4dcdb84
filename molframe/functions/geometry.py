"""Vector algebra on columns. A vector is a triple of DOUBLE columns, so all of it stays in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(prefix: str = "", names: tuple[str, str, str] = ("x", "y", "z")) -> Vec:
    return tuple(F.col(f"{prefix}{n}") for n in names)


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b))


def scale(a: Vec, k) -> Vec:
    return tuple(p * k for p in a)


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def distance2(a: Vec, b: Vec) -> Column:
    d = sub(a, b)
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def angle(a: Vec, centre: Vec, b: Vec) -> Column:
    """Angle at `centre`, in radians."""
    u, v = sub(a, centre), sub(b, centre)
    return F.acos(clamp(dot(u, v) / F.greatest(norm(u) * norm(v), F.lit(1e-30)), -1, 1))


def torsion(a: Vec, b: Vec, c: Vec, d: Vec) -> Column:
    """Signed torsion about b-c, in radians."""
    b0, b1, b2 = sub(b, a), sub(c, b), sub(d, c)
    axis = scale(b1, 1 / F.greatest(norm(b1), F.lit(1e-30)))
    v = sub(b0, scale(axis, dot(b0, axis)))
    w = sub(b2, scale(axis, dot(b2, axis)))
    return F.atan2(dot(cross(axis, v), w), dot(v, w))


def finite(a: Vec) -> Column:
    """True if no part is null, NaN or infinite."""
    ok = [x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")) for x in a]
    return ok[0] & ok[1] & ok[2]
