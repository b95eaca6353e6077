"""Landing points as Parquet, clustered by place.

The raw sources re-parse text for every query. Landed points are doubles, so
comparisons reach the scan; rows lie along a Z-order curve, so each file and
row group covers a small area and the min/max statistics skip the rest.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TILE_WIDTH, TILE_X, TILE_Y = "tile_width", "tile_x", "tile_y"
_TILES = (TILE_WIDTH, TILE_X, TILE_Y)

# Z-order lattice: 31 bits per axis over [-16384, 16384), which holds every
# 4-digit coordinate. Values outside are clamped; that only affects clustering.
_HALF, _BITS = 16384.0, 31
_STEP = 2.0 * _HALF / (1 << _BITS)

# Tile numbers stay below this; places beyond it have no tile (NULL).
_MOST_TILES = float(1 << 53)

# The usual shift/mask steps that spread 32 bits to the even places.
_SPREAD = (
    (16, 0x0000FFFF0000FFFF),
    (8, 0x00FF00FF00FF00FF),
    (4, 0x0F0F0F0F0F0F0F0F),
    (2, 0x3333333333333333),
    (1, 0x5555555555555555),
)


def _spread(v: Column) -> Column:
    for shift, mask in _SPREAD:
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def z_order(x: Column, y: Column) -> Column:
    """Position on the Z-order curve as a BIGINT."""

    def lattice(v: Column) -> Column:
        i = F.least(F.greatest((v + F.lit(_HALF)) / F.lit(_STEP), F.lit(0.0)), F.lit(float((1 << _BITS) - 1)))
        return F.floor(i)

    return _spread(lattice(x)).bitwiseOR(F.shiftleft(_spread(lattice(y)), 1))


def _tile(v: Column, width: float) -> Column:
    """The number of the tile, NULL where it is too large (infinite places, too)."""
    at = v / F.lit(width)
    return F.when(F.abs(at) < F.lit(_MOST_TILES), F.floor(at))


def without_tiles(df: DataFrame) -> DataFrame:
    """Drop the tile columns that ``read_landed`` carries for pruning."""
    return df.drop(*_TILES) if TILE_X in df.columns else df


def prune_tiles(df: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """Skip whole tile directories that lie outside the closed box."""
    if TILE_X not in df.columns:
        return df
    if not all(map(math.isfinite, (xmin, ymin, xmax, ymax))):
        return df
    # The width comes from the directory itself; rows without a tile are anywhere.
    for name, lo, hi in ((TILE_X, xmin, xmax), (TILE_Y, ymin, ymax)):
        most = F.lit(_MOST_TILES)
        first, last = (F.least(F.greatest(F.lit(v) / F.col(TILE_WIDTH), -most), most) for v in (lo, hi))
        df = df.where(F.col(name).isNull() | F.col(name).between(F.floor(first), F.floor(last)))
    return df


def land_points(
    points: DataFrame,
    path: str,
    *,
    tile: float | None = None,
    files: int | None = None,
    mode: str = "errorifexists",
) -> DataFrame:
    """Write points to ``path`` and return them read back.

    One range shuffle on (place, salt): boundaries come from Spark's sample of
    the data, and the salt lets a place that holds a large share of the rows
    spread over several files. Without an ``id`` the salt is the row's number in
    its scan, which a retried task repeats. ``files`` fixes the number of write tasks; by default adaptive
    execution sizes them.

    ``tile`` (a power of two, in coordinate units) adds one directory per tile,
    so that box and circle queries never open files far away; meant for tables
    of many thousand files.
    """
    if tile is not None and (tile <= 0 or math.frexp(tile)[0] != 0.5):
        raise ValueError("tile must be a power of two")
    points = without_tiles(points)
    columns = points.columns
    salt = F.col("id") if "id" in columns else F.monotonically_increasing_id()
    rows = points.withColumns({"_z": z_order(F.col("x"), F.col("y")), "_salt": F.xxhash64(salt)})
    spread = [F.col("_z"), F.col("_salt")]
    rows = rows.repartitionByRange(files, *spread) if files else rows.repartitionByRange(*spread)

    written, order = [F.col(f"`{c}`") for c in columns], [F.col("_z")]
    if tile is not None:
        rows = rows.withColumns({TILE_WIDTH: F.lit(float(tile)), TILE_X: _tile(F.col("x"), tile), TILE_Y: _tile(F.col("y"), tile)})
        written += [F.col(c) for c in _TILES]
        order = [F.col(c) for c in _TILES] + order
    rows = rows.sortWithinPartitions(*order).select(*written)
    writer = rows.write.mode(mode)
    (writer.partitionBy(*_TILES) if tile is not None else writer).parquet(path)
    return read_landed(points.sparkSession, path, schema_of=points, tile=tile)


def read_landed(
    spark: SparkSession, path: str, *, tile: float | None = None, schema_of: DataFrame | None = None
) -> DataFrame:
    """Open landed points. For a table with tiles pass ``tile``; the tile columns
    then serve for pruning, with the width that the table was landed with, and are
    dropped by every operator."""
    reader = spark.read
    if schema_of is not None:
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema_of.schema.fields)
        if tile is not None:
            ddl += f", {TILE_WIDTH} DOUBLE, {TILE_X} BIGINT, {TILE_Y} BIGINT"
        reader = reader.schema(ddl)
    df = reader.parquet(path)
    return without_tiles(df) if tile is None else df
