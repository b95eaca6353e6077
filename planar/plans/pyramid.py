"""Counts of points on nested grid cells, and the bounds on distances they give.

A cell of level ``e`` is ``2 ** e`` wide, its index the coordinate divided by that and
rounded down, which is exact for doubles, so the corners of a cell are exact as well.
Levels lie ``STEP`` apart: a cell has up to 16 cells of the next one. The finest level
has a few points per cell on average; a cell with very many gets finer levels of its
own, and only the points in such cells are read again for it. All tables stay
distributed and are as small as the number of occupied cells.

Bounds are safe whatever the counts: a cell's points are nearer than its farthest
corner and farther than its nearest one.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from planar.plans.lookup import attach
from planar.plans.scratch import stored
from planar.plans.sizing import fits_broadcast, spread

STEP = 2
# Points per cell of the finest level, on average; above so many times k a cell is split.
LEAF_POINTS = 4
_SPLIT_POINTS, _SPLIT_TIMES = 4_096, 64
# Levels (exponents) that a split adds.
_SPLIT_LEVELS = 8
# Bits of a coordinate that cells can tell apart.
_BITS = 50
# Slack for rounding in distances, as a share.
_SLACK = 1e-12

KEYS = ["_lv", "_ix", "_iy"]
_CELL = "struct<_lv:int,_ix:bigint,_iy:bigint,_n:bigint>"


@dataclass
class Pyramid:
    """``cells``: ``_lv, _ix, _iy``, points ``_n`` and the next finer cells ``_kids``; a
    cell of a finest level has itself there. ``levels`` are the exponents in use;
    ``small`` says whether ``cells`` was measured to fit a broadcast."""

    cells: DataFrame
    levels: list[int]
    extent: Row
    small: bool


def _index(v: Column, level: Column | int) -> Column:
    width = F.pow(F.lit(2.0), level) if isinstance(level, Column) else F.lit(2.0**level)
    return F.floor(v / width)


def _exponents(extent: Row, total: int) -> tuple[int, int, int]:
    """Of the finest level, the coarsest one, and the least that doubles allow."""
    spans = [extent["highx"] - extent["lowx"], extent["highy"] - extent["lowy"]]
    largest = max(abs(extent[f"{n}{c}"]) for n in ("low", "high") for c in "xy")
    least = math.frexp(largest)[1] - _BITS if largest else 0
    share = LEAF_POINTS / total
    # By area, or along a line where the points lie on one.
    width = max(math.sqrt(spans[0] * share) * math.sqrt(spans[1]), max(spans) * share)
    leaf = max(least, math.floor(math.log2(width))) if width > 0 else least
    top = leaf
    while 2.0**top < max(spans):
        top += STEP
    return leaf, top, least


def build(points: DataFrame, extent: Row, k: int, without_copies: Callable[[DataFrame], DataFrame]) -> tuple[Pyramid, DataFrame]:
    """The pyramid over the finite ``points`` within ``extent`` (``lowx``, ``highx``,
    ``lowy``, ``highy``, number ``n``), and the points. They are read once; if a place has
    very many, ``without_copies`` takes away those of its copies that no answer can
    need, and the points in crowded cells are read again, once per split."""
    leaf, top, least = _exponents(extent, extent["n"])

    def counted(df: DataFrame, level: int) -> DataFrame:
        cells = df.groupBy(_index(F.col("x"), level).alias("_ix"), _index(F.col("y"), level).alias("_iy"))
        return stored(cells.agg(F.count(F.lit(1)).alias("_n")), "pyramid-leaves")

    crowd = F.col("_n") > max(_SPLIT_POINTS, _SPLIT_TIMES * k)
    rounds = [(leaf, counted(points.select("x", "y"), leaf))]
    if not rounds[0][1].where(crowd).isEmpty():
        points = without_copies(points)
        rounds[0] = (leaf, counted(points.select("x", "y"), leaf))
    part = points.select("x", "y")
    while rounds[-1][0] - _SPLIT_LEVELS >= least:
        level, leaves = rounds[-1]
        full = leaves.where(crowd).select("_ix", "_iy")
        if full.isEmpty():
            break
        full = F.broadcast(full) if fits_broadcast(full) else full
        on = (_index(F.col("x"), level) == full["_ix"]) & (_index(F.col("y"), level) == full["_iy"])
        part = part.join(full, on, "left_semi")
        rounds.append((level - _SPLIT_LEVELS, counted(part, level - _SPLIT_LEVELS)))

    cells, ends, levels, above = None, None, [], top
    for i, (level, leaves) in enumerate(rounds):
        own = list(range(level, above + 1, STEP))
        levels += own
        above = level - STEP
        lv = F.explode(F.array(*[F.lit(v) for v in own])).alias("_lv")
        coarser = leaves.select(lv, "_ix", "_iy", "_n")
        by = F.col("_lv") - level
        coarser = coarser.groupBy("_lv", F.expr(f"shiftright(_ix, _lv - {level})").alias("_ix"), F.expr(
            f"shiftright(_iy, _lv - {level})").alias("_iy")).agg(F.sum("_n").alias("_n")) if len(own) > 1 else coarser
        last = leaves if i + 1 == len(rounds) else leaves.where(~crowd)
        last = last.select(F.lit(level).alias("_lv"), "_ix", "_iy", "_n")
        cells = coarser if cells is None else cells.unionByName(coarser)
        ends = last if ends is None else ends.unionByName(last)
    kid = F.struct("_lv", "_ix", "_iy", "_n").cast(_CELL)
    parents = cells.where(F.col("_lv") + STEP <= top).groupBy(
        (F.col("_lv") + STEP).alias("_plv"), F.expr(f"shiftright(_ix, {STEP})").alias("_pix"), F.expr(f"shiftright(_iy, {STEP})").alias("_piy"),
    ).agg(F.sum("_n").alias("_pn"), F.collect_list(kid).alias("_kids"))
    parents = parents.select(*[F.col(f"_p{c}").alias(f"_{c}") for c in ("lv", "ix", "iy", "n")], "_kids")
    cells = parents.unionByName(ends.withColumn("_kids", F.array(kid)))
    cells = stored(cells, "pyramid")
    return Pyramid(cells, sorted(levels), extent, fits_broadcast(cells)), points


# --- distances of cells --------------------------------------------------------


def _sides(cell: Column, axis: str, extent: Row) -> tuple[Column, Column]:
    """A cell's ends on an axis, cut to the extent."""
    width = F.pow(F.lit(2.0), cell["_lv"])
    at = cell[f"_i{axis}"]
    return F.greatest(at * width, F.lit(extent[f"low{axis}"])), F.least((at + 1) * width, F.lit(extent[f"high{axis}"]))


def _farthest(cell: Column, extent: Row) -> Column:
    """Distance that no point of the cell exceeds."""
    gaps = []
    for axis in "xy":
        low, high = _sides(cell, axis, extent)
        v = F.col(f"_q{axis}")
        gaps.append(F.greatest(F.abs(v - low), F.abs(high - v)))
    return F.sqrt(gaps[0] * gaps[0] + gaps[1] * gaps[1]) * (1.0 + _SLACK)


def _nearest(cell: Column, extent: Row) -> Column:
    """Distance that no point of the cell is below."""
    gaps = []
    for axis in "xy":
        low, high = _sides(cell, axis, extent)
        v = F.col(f"_q{axis}")
        gaps.append(F.greatest(low - v, v - high, F.lit(0.0)))
    return F.sqrt(gaps[0] * gaps[0] + gaps[1] * gaps[1]) * (1.0 - _SLACK)


def _kth(cells: Column, distance: Callable[[Column], Column], k: int, nearest: bool) -> Column:
    """The distance by which ``k`` points are counted, taking cells from the good end."""
    listed = F.transform(cells, lambda c: F.struct(distance(c).alias("d"), c["_n"].alias("n")))
    listed = F.sort_array(listed, asc=nearest)
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("double").alias("d"))

    def take(got: Column, c: Column) -> Column:
        n = got["n"] + c["n"]
        return F.struct(n.alias("n"), F.when(got["n"] >= k, got["d"]).when(n >= k, c["d"]).alias("d"))

    return F.aggregate(listed, start, take)["d"]


def nearest_bounds(queries: DataFrame, pyramid: Pyramid, k: int) -> DataFrame:
    """``q, _qx, _qy`` (from a scan) with ``_r``: the ``k`` nearest points are not farther.

    The finest level on which the 3x3 cells around a centre have ``k`` points is found
    from the counts; the next finer cells of those give the bound. A centre outside
    the extent sees an edge of it rather, and takes the bound of ``best_cells``. In a
    pyramid too large for a broadcast, a cell that several centres ask for is looked up
    once."""
    ends, own_keys = pyramid.extent, [f"_c{c}" for c in KEYS]
    within = [F.col(f"_q{c}").between(ends[f"low{c}"], ends[f"high{c}"]) for c in "xy"]
    remote, queries = queries.where(~(within[0] & within[1])), queries.where(within[0] & within[1])
    own = queries.select("q", F.col("_qx").alias("_x"), F.col("_qy").alias("_y"))
    own = own.withColumn("_c_lv", F.explode(F.array(*map(F.lit, pyramid.levels))))
    own = own.select("q", "_c_lv", *[_index(F.col(f"_{c}"), F.col("_c_lv")).alias(f"_c_i{c}") for c in "xy"])
    step = F.array(*[F.lit(v).cast("bigint") for v in (-1, 0, 1)])

    def around(rows: DataFrame, value: str, agg: Column) -> DataFrame:
        """``agg`` of the values of the 3x3 cells around the cell of each row."""
        group = ["q", *own_keys] if pyramid.small else own_keys
        asked = rows.select(*group) if pyramid.small else rows.select(*group).distinct()
        asked = asked.withColumn("_dx", F.explode(step)).withColumn("_dy", F.explode(step)).select(
            *group, F.col("_c_lv").alias("_lv"), (F.col("_c_ix") + F.col("_dx")).alias("_ix"), (F.col("_c_iy") + F.col("_dy")).alias("_iy"))
        table = pyramid.cells.select(*KEYS, value)
        found = asked.join(F.broadcast(table) if pyramid.small else table.hint("merge"), KEYS).groupBy(*group).agg(agg)
        return found if pyramid.small else attach(rows, stored(found, "cells-around"), own_keys, "inner")

    rich = around(own, "_n", F.sum("_n").alias("_m")).where(F.col("_m") >= k)
    chosen = rich.groupBy("q").agg(F.min(F.struct(*own_keys)).alias("cell")).select("q", "cell.*")
    chosen = chosen if pyramid.small else stored(chosen, "chosen-cells")
    near = around(chosen, "_kids", F.flatten(F.collect_list("_kids")).alias("_near")).select("q", "_near")
    r = F.when(F.col("_near").isNotNull(), _kth(F.col("_near"), lambda c: _farthest(c, ends), k, True))
    bounds = queries.join(near, "q", "left").withColumn("_r", r).select("q", "_qx", "_qy", "_r")
    if not remote.isEmpty():
        bounds = bounds.unionByName(best_cells(remote, pyramid, k, True).drop("_cells"))
    return stored(bounds.withColumn("_r", F.when(F.col("_r") < F.lit(float("inf")), F.col("_r"))), "knn-bounds")


# Cells of the first level per axis; a centre is done when its cells have few points for
# its k, or are many.
_START_CELLS, _ENOUGH_TIMES, _MOST_CELLS = 16, 16, 1_024


def best_cells(queries: DataFrame, pyramid: Pyramid, k: int, nearest: bool) -> DataFrame:
    """``q, _qx, _qy`` (from a scan) with ``_r``, such that the ``k`` nearest points are not
    farther, or the ``k`` farthest ones not nearer; and ``_cells``: all cells that reach up to
    that, or beyond.

    Starts from a level of at most 17 x 17 cells beside every centre, then looks into
    the cells that are left, level by level."""
    ends = pyramid.extent
    span = max(ends["highx"] - ends["lowx"], ends["highy"] - ends["lowy"])
    start = next(v for v in pyramid.levels if span / 2.0**v <= _START_CELLS)
    first = pyramid.cells.where(F.col("_lv") == start).agg(
        F.collect_list(F.struct(*KEYS, "_n").cast(_CELL)).alias("_cells"))

    def pruned(df: DataFrame) -> DataFrame:
        sure, best = (_farthest, _nearest) if nearest else (_nearest, _farthest)
        df = df.withColumn("_r", _kth(F.col("_cells"), lambda c: sure(c, ends), k, nearest))
        good = lambda d: d <= F.col("_r") if nearest else d >= F.col("_r")
        df = df.withColumn("_cells", F.filter("_cells", lambda c: F.col("_r").isNull() | good(best(c, ends))))
        points = F.aggregate("_cells", F.lit(0).cast("bigint"), lambda n, c: n + c["_n"])
        few = points <= max(_ENOUGH_TIMES * k, _ENOUGH_TIMES * LEAF_POINTS)
        return df.withColumn("_done", few | (F.size("_cells") > _MOST_CELLS))

    def finer(df: DataFrame) -> DataFrame:
        """The cells of the centres, split."""
        asked = df.select("q", "_qx", "_qy", F.inline("_cells")).drop("_n")
        kids = pyramid.cells.select(*KEYS, "_kids")
        # Most centres ask for the same corners.
        asked = asked.join(F.broadcast(kids), KEYS) if pyramid.small else attach(asked, kids, KEYS, "inner")
        return asked.groupBy("q", "_qx", "_qy").agg(F.flatten(F.collect_list("_kids")).alias("_cells"))

    # Stored on every level: Spark would move the bound into the test of each cell, and
    # work it out once per cell.
    out = stored(pruned(spread(queries).withColumn("_cells", first.scalar())), "far-cells")
    done = []
    for _ in range(sum(v < start for v in pyramid.levels)):
        if out.where(~F.col("_done")).isEmpty():
            break
        done.append(out.where("_done"))
        out = stored(pruned(finer(out.where(~F.col("_done")))), "far-cells")
    return reduce(DataFrame.unionByName, [*done, out]).drop("_done")
