"""The k nearest or farthest points to one location."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from planar.functions.exprs import distance, is_located
from planar.operators.range import circle_bounds, within_bounds
from planar.plans.sizing import scan_tasks
from planar.sources.landing import without_tiles

# Up to this many rows may meet in the one task that merges the top-k of all
# scan tasks; above it the candidates are narrowed first.
MERGE_ROWS = 2_000_000

# Distance buckets per doubling of the distance: about 2 % wide each.
_BUCKETS_PER_OCTAVE = 32
_BUCKET_AT_ZERO = -100_000
_MERGE_GROUPS = 256


def _distance_limit(distances: DataFrame, k: int, nearest: bool) -> DataFrame:
    """One value that the k-th best distance cannot be worse than.

    Counts rows per distance bucket (partial aggregation, a few thousand
    buckets at most), then takes buckets from the good end until k rows are
    covered. The limit is a distance that occurs in the data, so the filter on
    it is exact whatever the rounding of the bucket number.
    """
    d = F.col("d")
    bucket = F.coalesce(
        F.floor(F.log2(d) * F.lit(float(_BUCKETS_PER_OCTAVE))), F.lit(_BUCKET_AT_ZERO).cast("bigint")
    )
    edge = F.max(d) if nearest else F.min(d)
    buckets = distances.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), edge.alias("edge"))
    by_quality = F.col("bucket").asc() if nearest else F.col("bucket").desc()
    before = F.sum("n").over(Window.orderBy(by_quality).rowsBetween(Window.unboundedPreceding, -1))
    needed = buckets.withColumn("before", F.coalesce(before, F.lit(0).cast("bigint"))).where(F.col("before") < k)
    return needed.agg((F.max("edge") if nearest else F.min("edge")).alias("d"))


def _narrowed(
    points: DataFrame, cx: float, cy: float, d: Column, k: int, nearest: bool, order: list
) -> DataFrame:
    limit = _distance_limit(points.where(is_located()).select(d.alias("d")), k, nearest).first().d
    if limit is None:
        points = points.limit(0)
    elif nearest:
        # A little wider than the limit, for the rounding of x - cx.
        points = within_bounds(points, circle_bounds(cx, cy, limit * (1.0 + 1e-9))).where(d <= F.lit(limit))
    else:
        # One of the axes has at least this much of the distance; the four
        # comparisons reach the scan.
        part = limit / math.sqrt(2.0) * (1.0 - 1e-9)
        x, y = F.col("x"), F.col("y")
        far = (x >= cx + part) | (x <= cx - part) | (y >= cy + part) | (y <= cy - part)
        points = points.where(far).where(d >= F.lit(limit))
    # Many rows may share the limit distance (copies of one point), so the
    # candidates are cut to k per group of tasks before they meet in one task.
    rank = F.row_number().over(Window.partitionBy("_group").orderBy(*order))
    return (
        without_tiles(points.where(is_located()))
        .withColumn("distance", d)
        .withColumn("_group", F.spark_partition_id() % _MERGE_GROUPS)
        .withColumn("_rank", rank)
        .where(F.col("_rank") <= k)
        .drop("_group", "_rank")
    )


def knn(
    points: DataFrame,
    cx: float,
    cy: float,
    k: int,
    order: str = "nearest",
    method: str = "auto",
) -> DataFrame:
    """The ``k`` points with the smallest (``nearest``) or largest (``farthest``)
    distance, with a ``distance`` column, in that order. Ties go to the smaller
    ``id``, or without one to the smaller ``x, y``. Rows without a location are
    left out.

    ``scan`` keeps the best k per task in one pass and merges them in one task.
    ``narrow`` counts distances over ``x, y`` when called; the result then reads
    full rows just within the limit found, and for the nearest only the files
    and row groups around the centre. ``auto`` narrows when the merge would get
    more than ``MERGE_ROWS`` rows.
    """
    if order not in ("nearest", "farthest"):
        raise ValueError(f"unknown order {order!r}")
    if method not in ("auto", "scan", "narrow"):
        raise ValueError(f"unknown method {method!r}")
    nearest = order == "nearest"
    cx, cy = float(cx), float(cy)
    ties = ["id"] if "id" in points.columns else ["x", "y"]
    by = [F.col("distance").asc() if nearest else F.col("distance").desc(), *ties]
    d = distance("x", "y", cx, cy)

    if method == "auto":
        tasks = scan_tasks(points)
        method = "narrow" if tasks is None or tasks * k > MERGE_ROWS else "scan"
    if method == "narrow":
        candidates = _narrowed(points, cx, cy, d, k, nearest, by)
    else:
        candidates = without_tiles(points).where(is_located()).withColumn("distance", d)
    return candidates.orderBy(*by).limit(k)
