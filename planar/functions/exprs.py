"""Planar geometry as plain ``Column`` expressions.

A point is two doubles, so every predicate here stays inside whole-stage
codegen and the bare comparisons reach the Parquet scan as pushed filters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: coordinates are decimals with 4 integer and 20 fraction digits.
COORD_TYPE = "DECIMAL(24,20)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _num(v: Column | float) -> Column:
    """A double: a Python number becomes a literal, a Column is kept."""
    return v if isinstance(v, Column) else F.lit(float(v))


def coord(c: Column | str) -> Column:
    """Text or number to a coordinate; bad, NaN or too wide values give NULL."""
    return _col(c).try_cast(COORD_TYPE).cast("double")


def point(x: Column | str, y: Column | str) -> Column:
    return F.struct(_col(x).cast("double").alias("x"), _col(y).cast("double").alias("y"))


def envelope(x0, y0, x1, y1) -> Column:
    """Box from two opposite corners, given in any order."""
    x0, y0, x1, y1 = (_num(v) for v in (x0, y0, x1, y1))
    return F.struct(
        F.least(x0, x1).alias("xmin"),
        F.least(y0, y1).alias("ymin"),
        F.greatest(x0, x1).alias("xmax"),
        F.greatest(y0, y1).alias("ymax"),
    )


def inside(x: Column | str, y: Column | str, xmin, ymin, xmax, ymax) -> Column:
    """Strictly inside: a point on the edge is outside."""
    x, y = _col(x), _col(y)
    return (x > _num(xmin)) & (x < _num(xmax)) & (y > _num(ymin)) & (y < _num(ymax))


def contains(env: Column | str, p: Column | str) -> Column:
    """``inside`` for an ``envelope`` struct and a ``point`` struct."""
    env, p = _col(env), _col(p)
    return inside(
        p.getField("x"), p.getField("y"),
        env.getField("xmin"), env.getField("ymin"),
        env.getField("xmax"), env.getField("ymax"),
    )


def distance(ax, ay, bx, by) -> Column:
    """Planar distance. The products are spelled out (no ``hypot``/``pow``) so
    that any IEEE engine returns the same bits."""
    ax, ay, bx, by = (_col(v) if isinstance(v, str) else _num(v) for v in (ax, ay, bx, by))
    dx, dy = ax - bx, ay - by
    return F.sqrt(dx * dx + dy * dy)


def is_located(x: Column | str = "x", y: Column | str = "y") -> Column:
    """True for rows that hold a point. ``NaN`` equals itself in Spark, so the
    range test also drops it; the comparisons are pushed to the scan."""
    x, y = _col(x), _col(y)
    inf = float("inf")
    return x.between(-inf, inf) & y.between(-inf, inf)


def is_finite(x: Column | str = "x", y: Column | str = "y") -> Column:
    """True for rows that hold a point that is not at infinity."""
    x, y = _col(x), _col(y)
    inf = float("inf")
    return (x > -inf) & (x < inf) & (y > -inf) & (y < inf)
