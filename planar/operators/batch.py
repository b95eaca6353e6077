"""Many queries at once: a query table joined to the points in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from planar.functions.exprs import distance, inside, is_finite, is_located
from planar.operators.join import distance_join
from planar.operators.summed import CELLS, batch_box_count_summed
from planar.plans.grid import CELL, CUT_PARTS, LEVEL, box_copies, level_index, pack_sql, with_box_cells, with_level_cells
from planar.plans.pyramid import best_cells, build, nearest_bounds
from planar.plans.scratch import stored
from planar.plans.sizing import BROADCAST_BYTES, broadcast_copies, fits_broadcast, spread
from planar.plans.skew import BLOCK_ROWS, cell_join
from planar.sources.landing import without_tiles

# Cells per axis of a box: many if the box table then still fits for broadcast.
_FINE, _COARSE = 8, 2

# Fixed values of the query generator: a prime modulus and multipliers for it.
_MODULUS = 2_147_483_647
_MULTIPLIERS = (48_271, 16_807)


def _draw(q: Column, seed: int, i: int) -> Column:
    """A number in [0, 1) from the query number, the same on every run and
    partitioning, in integer arithmetic that other engines reproduce."""
    p = F.lit(_MODULUS).cast("bigint")

    def lit(v: int) -> Column:
        return F.lit(v).cast("bigint")

    a = (q % p * lit(_MULTIPLIERS[0]) + lit(seed * 7_919 + (i + 1) * 104_729)) % p
    return ((a * a + a * lit(_MULTIPLIERS[1])) % p).cast("double") / p.cast("double")


def workload(ids: DataFrame, seed: int = 1, size: float = 1.0, q: str = "q") -> DataFrame:
    """Random boxes and centres, one of each per row of ``ids`` (column ``q``).

    A box has its upper corner at ``(180 t1, 90 t2)`` and extends ``size`` times
    (180, 90) down and left; a centre is ``(180 (t1 - t2), 90 (t2 - t3))``.
    """
    t1, t2, t3 = (_draw(F.col(q).cast("bigint"), seed, i) for i in range(3))
    w, h = F.lit(180.0), F.lit(90.0)
    s = F.lit(float(size))
    return ids.select(
        F.col(q).cast("bigint").alias("q"),
        ((t1 - s) * w).alias("x0"),
        ((t2 - s) * h).alias("y0"),
        (t1 * w).alias("x1"),
        (t2 * h).alias("y1"),
        ((t1 - t2) * w).alias("cx"),
        ((t2 - t3) * h).alias("cy"),
    )


def _cell_choice(queries: DataFrame, factor: int, strategy: str, limit: int) -> tuple[bool, int]:
    """Whether to broadcast the copies of ``queries``, and the cells per axis."""
    if strategy not in ("auto", "broadcast", "shuffle"):
        raise ValueError(f"unknown strategy {strategy!r}")
    if strategy == "shuffle":
        return False, _COARSE
    choices = {factor * box_copies(parts): parts for parts in (_FINE, _COARSE)}
    parts = choices.get(broadcast_copies(queries, list(choices), limit))
    return (True, parts) if parts else (False, _COARSE)


def batch_box(
    points: DataFrame,
    boxes: DataFrame,
    *,
    strategy: str = "auto",
    block_rows: int = BLOCK_ROWS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``q`` and the point, for every point strictly inside every box.

    ``boxes`` has a unique ``q`` and corners ``x0, y0, x1, y1`` in any order. A
    box is looked up through the few grid cells it touches; with boxes of mixed
    sizes a point has one cell per size class.
    """
    points = without_tiles(points).where(is_located())
    output = _checked(points)
    queries = boxes.select(
        "q",
        F.least("x0", "x1").cast("double").alias("_xmin"),
        F.least("y0", "y1").cast("double").alias("_ymin"),
        F.greatest("x0", "x1").cast("double").alias("_xmax"),
        F.greatest("y0", "y1").cast("double").alias("_ymax"),
    ).where(
        # least/greatest skip NULLs, so the corners are tested themselves
        " AND ".join(f"{c} IS NOT NULL" for c in ("x0", "y0", "x1", "y1"))
    ).where((F.col("_xmax") > F.col("_xmin")) & (F.col("_ymax") > F.col("_ymin")))
    broadcast, parts = _cell_choice(queries, 1, strategy, broadcast_bytes)
    cells = with_box_cells(queries, *(F.col(c) for c in ("_xmin", "_ymin", "_xmax", "_ymax")), parts)
    if broadcast:
        points = spread(points, "id")
    hits = cell_join(
        with_level_cells(points, "x", "y", cells),
        cells,
        inside("x", "y", *(F.col(c) for c in ("_xmin", "_ymin", "_xmax", "_ymax"))),
        broadcast=broadcast,
        block_rows=block_rows,
    )
    return hits.select("q", *(F.col(f"`{c}`") for c in output))


def _checked(points: DataFrame) -> list[str]:
    """The columns of the points; results have ``q`` beside them."""
    if "q" in points.columns:
        raise ValueError("the points have a column q, like the results; rename it")
    return points.columns


# From so many points on, counts per box come from sums over cells.
SUMMED_ROWS = 1_000_000
# Places this many times the extent away from zero are left to the pairs.
_MOST_OFFSET = float(1 << 20)


def _summed_cells(points: DataFrame, summed_rows: int) -> int:
    """Cells per axis of a grid with about 16 points per cell, or more; 0 if the points are few
    or lie too far from zero for one."""
    ends = _extent(points.where(is_located()))
    if ends.n < max(1, summed_rows):
        return 0
    span = max(ends.highx - ends.lowx, ends.highy - ends.lowy)
    largest = max(abs(ends[f"{n}{c}"]) for n in ("low", "high") for c in "xy")
    if not 1e-100 < span < 1e100 or largest > span * _MOST_OFFSET:
        return 0
    return next((c for c in (1_024, 512) if c * c * 16 <= ends.n), CELLS)


def batch_box_count(points: DataFrame, boxes: DataFrame, *, summed_rows: int = SUMMED_ROWS, **options) -> DataFrame:
    """Number of points per box, zero included. Counts are combined before the
    shuffle, so the hits themselves never move.

    Of ``summed_rows`` points or more, those in the cells within a box are taken from sums,
    as in ``batch_box_count_summed``; pairs then grow with the edges of the boxes. A box
    with a corner that is no number has no cells; such are counted by pairs."""
    points = without_tiles(points)
    cells = _summed_cells(points, summed_rows)
    if not cells:
        return _count_by_pairs(points, boxes, **options)
    odd = F.lit(False)
    for c in ("x0", "y0", "x1", "y1"):
        odd |= F.coalesce(F.isnan(F.col(c).cast("double")), F.lit(False))
    odd = boxes.where(odd)
    counts = batch_box_count_summed(points, boxes, cells=cells, **options)
    if odd.isEmpty():
        return counts
    # Both count every q of the boxes.
    both = counts.distinct().unionByName(_count_by_pairs(points, odd, **options).distinct()).groupBy("q").agg(F.sum("n").alias("n"))
    return boxes.select("q").join(both, "q", "left").select("q", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def _count_by_pairs(points: DataFrame, boxes: DataFrame, **options) -> DataFrame:
    hits = batch_box(points.select("x", "y", *[c for c in points.columns if c == "id"]), boxes, **options)
    counts = hits.groupBy("q").agg(F.count(F.lit(1)).alias("n"))
    return boxes.select("q").join(counts, "q", "left").select(
        "q", F.coalesce("n", F.lit(0).cast("bigint")).alias("n")
    )


def batch_circle(points: DataFrame, centres: DataFrame, radius: float, **options) -> DataFrame:
    """``q``, the point and its distance, for every point closer than ``radius``
    to a centre. ``centres`` has a unique ``q`` and ``x, y``. This is the
    distance join with the query table on the right; options are passed to it."""
    output = _checked(without_tiles(points))
    right = centres.select(F.col("q").alias("id"), "x", "y")
    pairs = distance_join(points, right, radius, prefixes=("p_", "q_"), with_distance=True, **options)
    return pairs.select(
        F.col("q_id").alias("q"), *(F.col(f"`p_{c}`").alias(c) for c in output), "distance"
    )


def _best(df: DataFrame, group: list[str], order: list[Column | str], k: int, name: str) -> DataFrame:
    """The first ``k`` rows per group with their rank. Spark cuts before its shuffle
    for up to a thousand; beyond that, parts of the groups are cut first, so no task
    gets all candidates of a group."""
    if k > _WINDOW_CUT:
        part = Window.partitionBy(*group, "_part").orderBy(*order)
        df = df.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn(name, F.row_number().over(part))
        df = df.where(F.col(name) <= k).drop("_part", name)
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn(name, rank).where(F.col(name) <= k)


_WINDOW_CUT = 1_000
# Points are counted by so many values of a hash of their place.
_PLACES = 1 << 20


def _without_surplus_copies(points: DataFrame, total: int, k: int) -> DataFrame:
    """Of the copies of a hot point only the k smallest ids can be among the k
    nearest or farthest of anything. Hot places are found by counts per hash value, of
    which at most an eighth can be over the limit; that table is always small. The cut
    happens before the shuffle on each task."""
    place = F.pmod(F.xxhash64("x", "y"), F.lit(_PLACES).cast("bigint"))
    counts = points.groupBy(place.alias("_place")).agg(F.count(F.lit(1)).alias("n"))
    limit = max(1_000, 16 * k, 8 * total // _PLACES)
    hot = stored(counts.where(F.col("n") > limit).select("_place", F.lit(True).alias("_hot")), "hot-places")
    if hot.isEmpty():
        return points
    marked = points.withColumn("_place", place).join(F.broadcast(hot), "_place", "left").drop("_place")
    best = _best(marked.where("_hot"), ["x", "y"], ["id"], k, "_rank").drop("_rank", "_hot")
    return marked.where("_hot IS NULL").drop("_hot").unionByName(best)


def _extent(points: DataFrame):
    """Ends and number ``n`` of the finite points, and the number ``m`` of the others."""
    finite = is_finite()
    ends = [f(F.when(finite, F.col(c))).alias(f"{n}{c}") for c in "xy" for n, f in (("low", F.min), ("high", F.max))]
    return points.agg(*ends, F.count(F.when(finite, 1)).alias("n"), F.count(F.when(~finite, 1)).alias("m")).first()


def batch_knn(
    points: DataFrame,
    centres: DataFrame,
    k: int,
    *,
    order: str = "nearest",
    strategy: str = "auto",
    block_rows: int = BLOCK_ROWS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """The ``k`` nearest (or farthest) points of every centre: ``q``, the point,
    ``distance`` and rank ``rk``. Ties go to the smaller ``id``; points without one are
    written to the scratch folder with a number each, and ties go to the smaller ``x, y``.
    ``centres`` have a unique ``q`` and ``x, y``.

    Comparing every centre with every point is avoided by bounding each centre's k-th
    distance from a pyramid of counts. The nearest are then found by a join of circles
    with points on grid cells, the farthest by a join of the cells that reach beyond the
    bound with the points in them, and ranked. The result is exact: all points are
    looked at, and every one that is as good as the bound is ranked.

    The points are read three times whatever their number: for their extent, for the
    counts, and for the answer (and once more before a shuffled join, for its hot
    cells). Only where thousands lie in one cell of the finest level are those read
    again, to split it. Counts and bounds are stored in the scratch folder.
    """
    if k < 1:
        raise ValueError("k must be positive")
    if order not in ("nearest", "farthest"):
        raise ValueError(f"unknown order {order!r}")
    nearest = order == "nearest"
    points = without_tiles(points).where(is_located())
    output = _checked(points)
    ties = ["id"] if "id" in output else ["x", "y", "id"]
    if "id" not in output:
        points = stored(points.withColumn("id", F.monotonically_increasing_id()), "knn-points")
    extent = _extent(points)
    points = spread(points, "id")

    queries = centres.select(
        "q", F.col("x").cast("double").alias("_qx"), F.col("y").cast("double").alias("_qy")
    ).where(is_located("_qx", "_qy"))
    pyramid = None
    if extent.n >= k:
        finite = points.where(is_finite())
        pyramid, finite = build(finite, extent, k, lambda p: _without_surplus_copies(p, extent.n, k))
        # Centres may come from a shuffle; lookups in a large pyramid need a scan.
        queries = queries if pyramid.small else stored(queries, "knn-centres")
        points = finite.unionByName(points.where(~is_finite())) if extent.m else finite
    by = ["distance" if nearest else F.desc("distance"), *ties]
    find = _within_bounds if nearest else _beyond_bounds
    found = find(points, queries, pyramid, extent, k, strategy, block_rows, broadcast_bytes)
    best = _best(found.withColumn("distance", distance("x", "y", "_qx", "_qy")), ["q"], by, k, "rk")
    return best.select("q", *(F.col(f"`{c}`") for c in output), "distance", F.col("rk").cast("bigint").alias("rk"))


def _within_bounds(points, queries, pyramid, extent, k, strategy, block_rows, broadcast_bytes) -> DataFrame:
    """Pairs of a centre and a point in the circle that holds its ``k`` nearest."""
    if pyramid:
        circles = nearest_bounds(queries, pyramid, k)
    else:
        circles = queries.withColumn("_r", F.lit(None).cast("double"))
    circles = spread(circles, "q")
    # Twice the bytes, because the bounds come on top of the counted columns.
    broadcast, parts = _cell_choice(queries, 2, strategy, broadcast_bytes)
    reach = F.coalesce("_r", F.lit(float("inf"))) * F.lit(1.0 + 1e-9) + F.lit(1e-150)
    # A circle need not be looked up beyond the data. One that reaches in from
    # far outside is cut to what may be a thin slice, and gets finer cells.
    finite = reach < F.lit(float("inf"))
    low = [F.greatest(F.col(f"_q{c}") - reach, F.when(finite, F.lit(extent[f"low{c}"]))) for c in "xy"]
    high = [F.least(F.col(f"_q{c}") + reach, F.when(finite, F.lit(extent[f"high{c}"]))) for c in "xy"]
    cut = F.greatest(high[0] - low[0], high[1] - low[1]) < reach
    share = F.when(cut, F.lit(float(CUT_PARTS))).otherwise(F.lit(float(parts)))
    ends = [F.greatest(h, l) for l, h in zip(low, high)]
    cells = with_box_cells(circles, *low, *ends, share, ("_qx", "_qy", reach))
    r = F.col("_r")
    return cell_join(
        with_level_cells(points, "x", "y", cells),
        cells,
        r.isNull() | (distance("x", "y", "_qx", "_qy") <= r),
        broadcast=broadcast and fits_broadcast(cells, 1, broadcast_bytes),
        block_rows=block_rows,
    )


def _beyond_bounds(points, queries, pyramid, extent, k, strategy, block_rows, broadcast_bytes) -> DataFrame:
    """Pairs of a centre and a point outside the circle that leaves ``k`` outside."""
    if strategy not in ("auto", "broadcast", "shuffle"):
        raise ValueError(f"unknown strategy {strategy!r}")
    if not pyramid:
        return _within_bounds(points, queries, None, extent, k, strategy, block_rows, broadcast_bytes)
    cells = best_cells(queries, pyramid, k, False).select("q", "_qx", "_qy", "_r", F.inline("_cells")).drop("_n")
    cells = cells.withColumnsRenamed({"_lv": LEVEL}).withColumn(CELL, F.expr(pack_sql("_ix", "_iy")))
    cells = spread(stored(cells, "far-cells"), "q")
    r = F.col("_r")
    # Packed keys may alias; a centre has cells far from each other.
    own = (level_index("x") == F.col("_ix")) & (level_index("y") == F.col("_iy"))
    pairs = cell_join(
        with_level_cells(points.where(is_finite()), "x", "y", cells),
        cells,
        own & (r.isNull() | (distance("x", "y", "_qx", "_qy") >= r)),
        broadcast=strategy != "shuffle" and fits_broadcast(cells, 1, broadcast_bytes),
        block_rows=block_rows,
    ).drop("_ix", "_iy")
    if not extent.m:
        return pairs
    # Points at infinity are the farthest of all; the first k are enough for any centre.
    ties = [c for c in ("x", "y") if "id" not in points.columns] + ["id"]
    first = points.where(~is_finite()).orderBy(*ties).limit(k)
    first = first.agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in points.columns])).alias("_first"))
    beyond = queries.withColumn("_r", F.lit(None).cast("double")).withColumn("_first", first.scalar())
    return pairs.unionByName(beyond.select("q", "_qx", "_qy", "_r", F.inline("_first")))
