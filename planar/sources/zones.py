"""A zone table beside landed points: where the points of each file lie.

``land_points`` orders rows along a curve, so a file covers a small area. With its
extent and number of rows known, a top-k query opens only files that can hold an answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planar.functions.exprs import is_finite
from planar.operators.knn import knn
from planar.sources.landing import read_landed

# Spark skips names with an underscore in front when it reads the points.
ZONES = "_zones"
# Beyond so many files with a possible answer, the whole table is read.
MOST_FILES = 10_000
# Slack for rounding in distances, as a share.
_SLACK = 1e-12
_SCHEMA = "file STRING, lowx DOUBLE, highx DOUBLE, lowy DOUBLE, highy DOUBLE, n BIGINT, others BIGINT"


def write_zones(spark: SparkSession, path: str, *, tile: float | None = None, mode: str = "overwrite") -> DataFrame:
    """Write the zone table of the points landed at ``path`` into a folder below it: per
    file the extent of its finite points, their number ``n`` and that of the ``others``
    with a place. Reads ``x`` and ``y`` once; to be done after every landing."""
    points, finite = read_landed(spark, path, tile=tile), is_finite()
    ends = [f(F.when(finite, F.col(c))).alias(f"{n}{c}") for c in "xy" for n, f in (("low", F.min), ("high", F.max))]
    located = F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y")
    zones = points.select(F.input_file_name().alias("file"), "x", "y").groupBy("file").agg(
        *ends, F.count(F.when(finite, 1)).alias("n"), F.count(F.when(located & ~finite, 1)).alias("others"))
    zones.write.mode(mode).parquet(f"{path.rstrip('/')}/{ZONES}")
    return read_zones(spark, path)


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_SCHEMA).parquet(f"{path.rstrip('/')}/{ZONES}")


def _corner(cx: float, cy: float, far: bool) -> Column:
    """Distance of a zone's farthest or nearest possible point, with slack outwards."""
    gaps = []
    for c, v in (("x", cx), ("y", cy)):
        below, above = F.lit(v) - F.col(f"low{c}"), F.col(f"high{c}") - F.lit(v)
        gaps.append(F.greatest(F.abs(below), F.abs(above)) if far else F.greatest(-below, -above, F.lit(0.0)))
    return F.sqrt(gaps[0] * gaps[0] + gaps[1] * gaps[1]) * (1.0 + _SLACK if far else 1.0 - _SLACK)


def files_for(zones: DataFrame, cx: float, cy: float, k: int, order: str = "nearest") -> DataFrame:
    """``file`` of every zone that may hold one of the ``k`` nearest (or farthest) points.

    Zones are taken by their largest possible distance (smallest, for the farthest)
    until they have ``k`` points, which takes ``k`` zones at most; what is surely worse
    than that is left out."""
    nearest = order == "nearest"
    zones = zones.withColumns({"near": _corner(cx, cy, False), "far": _corner(cx, cy, True)})
    held = zones.where("n > 0")
    by = F.col("far").asc() if nearest else F.col("near").desc()
    total, limit = 0, None
    for row in held.orderBy(by).limit(k).select("n", "near", "far").collect():
        total += row.n
        if total >= k:
            limit = row.far if nearest else row.near
            break
    good = F.lit(True) if limit is None else (F.col("near") <= limit if nearest else F.col("far") >= limit)
    # Points at infinity are the farthest, and the nearest where others are too few.
    more = F.col("others") > 0 if limit is None or not nearest else F.lit(False)
    return zones.where(((F.col("n") > 0) & good) | more).select("file")


def knn_landed(
    spark: SparkSession, path: str, cx: float, cy: float, k: int, order: str = "nearest", *, tile: float | None = None,
) -> DataFrame:
    """``knn`` over points landed at ``path`` that have a zone table, reading only files
    that can hold an answer. The names of these files pass through the driver; if there
    are more than ``MOST_FILES``, the whole table is read."""
    if order not in ("nearest", "farthest"):
        raise ValueError(f"unknown order {order!r}")
    cx, cy = float(cx), float(cy)
    chosen = [r.file for r in files_for(read_zones(spark, path), cx, cy, k, order).limit(MOST_FILES + 1).collect()]
    points = read_landed(spark, path, tile=tile)
    if not chosen:
        return knn(points.limit(0), cx, cy, k, order)
    if len(chosen) <= MOST_FILES:
        reader = spark.read.schema(points.schema)
        # The tiles are part of the folders' names.
        points = (reader.option("basePath", path) if tile is not None else reader).parquet(*chosen)
    return knn(points, cx, cy, k, order)
