"""Distance join of two point tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planar.functions.exprs import distance, is_finite
from planar.plans.grid import (
    CELL, HALF_STEPS, cell_width, occupied, only_occupied, with_cell, with_half_neighbour_cells, with_neighbour_cells,
)
from planar.plans.scratch import stored
from planar.plans.sizing import BROADCAST_BYTES, estimated_bytes, fits_broadcast
from planar.plans.skew import BLOCK_ROWS, cell_join, scanned, spread_by_place
from planar.sources.landing import without_tiles

_COPIES = 9
# Rows per cell from which a self join writes each order of its pairs on its own.
_CROWD = 16


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select([F.col(f"`{c}`").alias(prefix + c) for c in df.columns])


def _met(cells: DataFrame, copies: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of ``cells`` that ``copies`` has a row in the cell of, if that can be told
    by a broadcast of bounded size; else all rows."""
    words = stored(occupied(copies), "occupied-cells")
    return only_occupied(cells, F.broadcast(words)) if fits_broadcast(words, 1, limit) else cells


def _crowded(points: DataFrame, width: float) -> bool:
    """Whether a point's cell has ``_CROWD`` rows or more, on the average of all points."""
    cells = with_cell(points, "x", "y", width).groupBy(CELL).agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows, met = cells.agg(F.sum("n"), F.sum(F.col("n") * F.col("n"))).first()
    return bool(rows) and met >= _CROWD * rows


def self_join(
    points: DataFrame,
    radius: float,
    *,
    strategy: str = "auto",
    prefixes: tuple[str, str] = ("a_", "b_"),
    with_distance: bool = False,
    block_rows: int = BLOCK_ROWS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``distance_join`` of a table with itself, at half the comparisons.

    A point meets those in its own cell with a larger number in the scan, and all in
    four of the eight cells around; every pair found is given in both orders, and every
    point with itself once. In crowded cells the rows found far outweigh the comparisons;
    each order is then found on its own from the same shuffled tables, so that the rows of
    a point stay together and are written in a fraction of the bytes. A table that comes out of a shuffle is written to the
    scratch folder first, for its rows to keep their numbers.
    """
    if strategy not in ("auto", "broadcast", "shuffle"):
        raise ValueError(f"unknown strategy {strategy!r}")
    pa, pb = prefixes
    if pa == pb:
        raise ValueError("the two prefixes must differ")
    radius = float(radius)
    if not math.isfinite(radius):
        raise ValueError("the radius must be finite")
    points = scanned(without_tiles(points))
    columns = points.columns
    points = points.withColumn("_n", F.monotonically_increasing_id()).where(is_finite())
    if not radius > 0.0:
        points = points.limit(0)
    a, b = _prefixed(points, pa), _prefixed(points, pb)
    broadcast = strategy != "shuffle" and fits_broadcast(b, 1 + len(HALF_STEPS), broadcast_bytes)
    largest = points.agg(F.max(F.greatest(F.abs("x"), F.abs("y")))).first()[0] or 0.0
    width = cell_width(radius, largest)
    d = distance(pa + "x", pa + "y", pb + "x", pb + "y")
    cells, place = with_cell(a, pa + "x", pa + "y", width), (pa + "x", pa + "y")
    half = cell_join(
        spread_by_place(cells, CELL, *place) if broadcast else cells,
        with_half_neighbour_cells(b, pb + "x", pb + "y", width, "_apart"),
        (F.col("_apart") | (F.col(f"{pa}_n") < F.col(f"{pb}_n"))) & (d < F.lit(radius)),
        broadcast=broadcast,
        block_rows=max(1, block_rows),
        order=place,
    )

    def pair(first: str, second: str) -> list[Column]:
        return [F.col(f"`{p}{c}`").alias(q + c) for p, q in ((first, pa), (second, pb)) for c in columns]

    if _crowded(points, width):
        pairs = half.select(*pair(pa, pb)).unionByName(half.select(*pair(pb, pa)))
    else:
        pairs = half.select(F.inline(F.array(F.struct(*pair(pa, pb)), F.struct(*pair(pb, pa)))))
    out = pairs.unionByName(a.select(*[F.col(f"`{pa}{c}`").alias(q + c) for q in (pa, pb) for c in columns]))
    return out.withColumn("distance", d) if with_distance else out


def distance_join(
    left: DataFrame,
    right: DataFrame,
    radius: float,
    *,
    strategy: str = "auto",
    prefixes: tuple[str, str] = ("a_", "b_"),
    with_distance: bool = False,
    block_rows: int = BLOCK_ROWS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """All pairs closer than ``radius`` (strictly), as an inner join.

    The inputs have ``x`` and ``y``, optionally a unique ``id``, and any other
    columns. Output columns carry ``prefixes``; ``with_distance`` adds
    ``distance``.

    The pairs come from an equi-join on grid cells. The smaller side is copied
    to the 3x3 cells around each point and is

    * ``broadcast``: sent to every task, if it was *measured* to fit into
      ``broadcast_bytes``; of the other side, the rows whose cell has a copy are put in
      order of place, so that the pairs of a place are written together;
    * ``shuffle``: shuffled with the other side on the cell, hot cells cut into
      blocks of about ``block_rows`` rows.

    ``auto`` and ``broadcast`` both fall back to ``shuffle`` for a side that
    does not fit. Before a shuffle (with ``broadcast``, that of a large scan), rows of the
    larger side whose cell has no copy of the smaller one are dropped at the scan, if a
    bitmap of those cells was measured to fit a broadcast. Joining a table with itself
    keeps identity pairs and both orders; the same DataFrame on both sides is joined by
    ``self_join``.
    """
    if left is right:
        return self_join(
            left, radius, strategy=strategy, prefixes=prefixes, with_distance=with_distance,
            block_rows=block_rows, broadcast_bytes=broadcast_bytes)
    if strategy not in ("auto", "broadcast", "shuffle"):
        raise ValueError(f"unknown strategy {strategy!r}")
    pa, pb = prefixes
    if pa == pb:
        raise ValueError("the two prefixes must differ")
    radius = float(radius)
    if not math.isfinite(radius):
        raise ValueError("the radius must be finite")
    # A point at infinity is closer than a finite radius to none.
    a = _prefixed(without_tiles(left).where(is_finite()), pa)
    b = _prefixed(without_tiles(right).where(is_finite()), pb)
    output = a.columns + b.columns
    if not radius > 0.0:
        a = a.limit(0)

    # Inner join on a symmetric condition: either side may be the copied one.
    size_a, size_b = estimated_bytes(a), estimated_bytes(b)
    if size_a is not None and size_b is not None and size_a < size_b:
        big, pbig, small, psmall = b, pb, a, pa
    else:
        big, pbig, small, psmall = a, pa, b, pb
    broadcast = strategy != "shuffle" and fits_broadcast(small, _COPIES, broadcast_bytes)

    # Points that are close to one of these are not much larger.
    largest = small.agg(F.max(F.greatest(F.abs(psmall + "x"), F.abs(psmall + "y")))).first()[0] or 0.0
    width = cell_width(radius, largest)
    apart = distance(pa + "x", pa + "y", pb + "x", pb + "y")
    cells, copies = with_cell(big, pbig + "x", pbig + "y", width), with_neighbour_cells(small, psmall + "x", psmall + "y", width)
    place = (pbig + "x", pbig + "y")

    def met(rows: DataFrame) -> DataFrame:
        return _met(rows, copies, broadcast_bytes)

    cells = spread_by_place(cells, CELL, *place, keep=met) if broadcast else met(cells)
    pairs = cell_join(cells, copies, apart < F.lit(radius), broadcast=broadcast, block_rows=max(1, block_rows), order=place)
    columns = [F.col(f"`{c}`") for c in output]
    return pairs.select(*columns, apart.alias("distance")) if with_distance else pairs.select(*columns)
