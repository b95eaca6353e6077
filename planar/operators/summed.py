"""Counts per box from a table of counts summed over both axes.

The points are counted on a grid of ``cells`` x ``cells``, once, and summed along both
axes. The points in all cells that lie within a box then take four reads of that table,
whatever the box's size; only points in the cells on its edge are compared with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from planar.functions.exprs import inside, is_finite
from planar.plans.grid import CELL, pack_sql
from planar.plans.scratch import stored
from planar.plans.sizing import BROADCAST_BYTES, fits_broadcast
from planar.plans.skew import BLOCK_ROWS, cell_join
from planar.sources.landing import without_tiles

CELLS = 256


def _power_of_two(span: float, cells: int) -> float:
    width = 1.0
    while width * cells < span:
        width *= 2.0
    while width > 2.0**-1000 and width * cells / 2.0 >= span > 0.0:
        width /= 2.0
    return width


def summed_counts(points: DataFrame, cells: int = CELLS) -> tuple[DataFrame, dict[str, float]]:
    """``_ix, _iy, _sum``: the points in cells up to ``(_ix, _iy)`` on both axes, and
    the grid: ``width`` and the first index of each axis.

    The table has ``(cells + 2) ** 2`` rows at most, whatever the number of points; it is
    complete, and stored. Indices are relative to the first cell with a point."""
    spark = points.sparkSession
    points = points.where(is_finite())
    ends = points.agg(*[f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("low", F.min), ("high", F.max))]).first()
    if ends.lowx is None:
        grid = {"width": 1.0, "x": 0, "y": 0}
        return spark.createDataFrame([], "_ix bigint, _iy bigint, _sum bigint"), grid
    width = _power_of_two(max(ends.highx - ends.lowx, ends.highy - ends.lowy), cells)
    first = {c: ends[f"low{c}"] // width for c in "xy"}
    last = {c: int(ends[f"high{c}"] // width - first[c]) for c in "xy"}
    grid = {"width": width, **first}
    index = [cell_index(F.col(c), c, grid).alias(f"_i{c}") for c in "xy"]
    counts = points.select(*index).groupBy("_ix", "_iy").agg(F.count(F.lit(1)).alias("_n"))
    wide = last["y"] + 1
    every = spark.range((last["x"] + 1) * wide).select(
        F.floor(F.col("id") / wide).alias("_ix"), (F.col("id") % wide).alias("_iy"))
    full = every.join(F.broadcast(counts), ["_ix", "_iy"], "left").select("_ix", "_iy", F.coalesce("_n", F.lit(0)).alias("_n"))
    upto = (Window.unboundedPreceding, Window.currentRow)
    for axis, other in (("_ix", "_iy"), ("_iy", "_ix")):
        full = full.withColumn("_n", F.sum("_n").over(Window.partitionBy(other).orderBy(axis).rowsBetween(*upto)))
    return stored(full.withColumnRenamed("_n", "_sum"), "summed-counts"), grid


def cell_index(v: Column, axis: str, grid: dict[str, float]) -> Column:
    """Relative index of the cell of a coordinate; exact, since the width is a power of two."""
    return (F.floor(v / F.lit(grid["width"])) - F.lit(int(grid[axis]))).cast("bigint")


def batch_box_count_summed(
    points: DataFrame,
    boxes: DataFrame,
    *,
    cells: int = CELLS,
    strategy: str = "auto",
    block_rows: int = BLOCK_ROWS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``batch_box_count`` for large boxes: ``q`` and the number ``n`` of points strictly
    inside, with ``boxes`` as there. Points compared grow with the edges of the boxes,
    not with their areas. The points are read three times (and once more for hot
    cells before a shuffled join)."""
    if strategy not in ("auto", "broadcast", "shuffle"):
        raise ValueError(f"unknown strategy {strategy!r}")
    points = without_tiles(points).select("x", "y").where(is_finite())
    sums, grid = summed_counts(points, cells)
    end = {c: F.lit(int(sums.agg(F.max(f"_i{c}")).first()[0] or 0)) for c in "xy"}
    known = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in ("x0", "y0", "x1", "y1")]
    queries = boxes.where(known[0] & known[1] & known[2] & known[3]).select(
        "q", F.least("x0", "x1").cast("double").alias("_xmin"), F.least("y0", "y1").cast("double").alias("_ymin"),
        F.greatest("x0", "x1").cast("double").alias("_xmax"), F.greatest("y0", "y1").cast("double").alias("_ymax"))
    far = float(1 << 40)
    for c in "xy":
        # Cells that the box touches, within the grid, and those that lie in it.
        low, high = (F.least(F.greatest(F.col(f"_{c}{m}") / F.lit(grid["width"]), F.lit(-far)), F.lit(far)) for m in ("min", "max"))
        base = F.lit(int(grid[c]))
        queries = queries.withColumns({
            f"_a{c}": F.greatest(F.floor(low) - base, F.lit(0)), f"_b{c}": F.least(F.floor(high) - base, end[c]),
            f"_p{c}": F.greatest(F.floor(low) + 1 - base, F.lit(0)), f"_r{c}": F.least(F.floor(high) - 1 - base, end[c])})
    queries = stored(queries, "summed-queries")
    whole = (F.col("_px") <= F.col("_rx")) & (F.col("_py") <= F.col("_ry"))

    corner = F.array(*[
        F.struct(F.col(f"_{x}").alias("_ix"), F.col(f"_{y}").alias("_iy"), F.lit(sign).alias("_sign"))
        for x, y, sign in (("rx", "ry", 1), ("lx", "ry", -1), ("rx", "ly", -1), ("lx", "ly", 1))])
    reads = queries.where(whole).withColumns({"_lx": F.col("_px") - 1, "_ly": F.col("_py") - 1}).select("q", F.inline(corner))
    inner = reads.join(F.broadcast(sums) if fits_broadcast(sums) else sums, ["_ix", "_iy"]).groupBy("q").agg(
        F.sum(F.col("_sum") * F.col("_sign")).alias("_n"))

    # The touched cells that do not lie within: whole rows above and below, and the rest
    # of the rows between.
    touched = queries.withColumn("_iy", F.explode(F.expr("CASE WHEN _ay <= _by AND _ax <= _bx THEN sequence(_ay, _by) END")))
    between = whole & (F.col("_iy") >= F.col("_py")) & (F.col("_iy") <= F.col("_ry"))
    columns = F.when(between, F.expr(
        "concat(CASE WHEN _ax < _px THEN sequence(_ax, _px - 1) ELSE array() END, "
        "CASE WHEN _rx < _bx THEN sequence(_rx + 1, _bx) ELSE array() END)")).otherwise(F.expr("sequence(_ax, _bx)"))
    edge = touched.withColumn("_ix", F.explode(columns)).select(
        "q", "_xmin", "_ymin", "_xmax", "_ymax", F.expr(pack_sql("_ix", "_iy")).alias(CELL))
    index = {f"_i{c}": cell_index(F.col(c), c, grid) for c in "xy"}
    placed = points.withColumns(index).withColumn(CELL, F.expr(pack_sql("_ix", "_iy"))).drop("_ix", "_iy")
    hits = cell_join(
        placed, edge, inside("x", "y", *(F.col(c) for c in ("_xmin", "_ymin", "_xmax", "_ymax"))),
        broadcast=strategy != "shuffle" and fits_broadcast(edge, 1, broadcast_bytes), block_rows=block_rows)
    compared = hits.groupBy("q").agg(F.count(F.lit(1)).alias("_n"))
    total = inner.unionByName(compared).groupBy("q").agg(F.sum("_n").alias("n"))
    return boxes.select("q").join(total, "q", "left").select("q", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))
