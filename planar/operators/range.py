"""Box and circle filters: narrow, one scan, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planar.functions.exprs import distance, inside
from planar.sources.landing import prune_tiles, without_tiles


def box_query(points: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Points strictly inside the box with these two opposite corners."""
    xmin, xmax = sorted((float(x0), float(x1)))
    ymin, ymax = sorted((float(y0), float(y1)))
    points = prune_tiles(points, xmin, ymin, xmax, ymax)
    return without_tiles(points.where(inside("x", "y", xmin, ymin, xmax, ymax)))


def circle_bounds(cx: float, cy: float, radius: float) -> tuple[float, float, float, float]:
    """Closed bounding box that holds every point of the circle, rounding included."""
    # A difference below 1e-150 squares to zero, hence the floor.
    r = max(float(radius), 1e-150)
    return cx - r, cy - r, cx + r, cy + r


def within_bounds(points: DataFrame, bounds: tuple[float, float, float, float]) -> DataFrame:
    """Points in the closed box ``(xmin, ymin, xmax, ymax)``, tiles kept."""
    xmin, ymin, xmax, ymax = bounds
    x, y = F.col("x"), F.col("y")
    return prune_tiles(points, *bounds).where((x >= xmin) & (x <= xmax) & (y >= ymin) & (y <= ymax))


def circle_query(points: DataFrame, cx: float, cy: float, radius: float) -> DataFrame:
    """Points closer than ``radius`` (strictly) to the centre.

    The distance itself cannot be pushed to a scan, so the bounding box goes
    along with it.
    """
    cx, cy, radius = float(cx), float(cy), float(radius)
    near = within_bounds(points, circle_bounds(cx, cy, radius))
    return without_tiles(near.where(distance("x", "y", cx, cy) < F.lit(radius)))


def count_rows(df: DataFrame, name: str = "n") -> DataFrame:
    """Row count as a one-row DataFrame."""
    return df.agg(F.count(F.lit(1)).alias(name))
