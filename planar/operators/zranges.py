"""Boxes as ranges of a Z-order curve, merged with points sorted along it.

A box is a bounded number of cells, and a cell is one range of the curve, whatever its
size. So points need one place on the curve, where ``batch_box`` needs one cell per size
class of the boxes. Points and ranges are dealt to parts of the curve, cut where the
points' quantiles are, sorted, and merged in one pass over each part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planar.functions.exprs import is_finite
from planar.operators.batch import _checked
from planar.plans.skew import scanned
from planar.sources.landing import _spread, without_tiles

# Points per part, parts at most, cells per axis of a box.
PART_ROWS, MOST_PARTS, CELLS = 250_000, 4_096, 4
# Rows of one output batch, about.
_BATCH = 100_000
_BITS = 20
_LAST = (1 << _BITS) - 1
_RANGE = ["_part", "_block", "_z", "_last"]
_CORNERS = ["_xmin", "_ymin", "_xmax", "_ymax"]


def _lattice(v: Column, low: float, high: float) -> Column:
    """Whole steps from ``low``; never decreases as ``v`` grows."""
    step = (high - low) / (1 << _BITS) or 1.0
    return F.floor(F.least(F.greatest((v - F.lit(low)) / F.lit(step), F.lit(0.0)), F.lit(float(_LAST))))


def _interleaved(v: np.ndarray) -> np.ndarray:
    out = np.zeros_like(v)
    for bit in range(_BITS):
        out |= ((v >> bit) & 1) << (2 * bit)
    return out


def ranges_of(i0: int, i1: int, j0: int, j1: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last places on the curve of the cells that cover a box of lattice
    steps; neighbouring ranges are joined."""
    level = 0
    while max(i1 - i0, j1 - j0) >> level >= cells:
        level += 1
    i, j = np.meshgrid(np.arange(i0 >> level, (i1 >> level) + 1), np.arange(j0 >> level, (j1 >> level) + 1))
    first = np.sort((_interleaved(i.ravel()) | (_interleaved(j.ravel()) << 1)) << (2 * level))
    last = first + (1 << (2 * level)) - 1
    begin = np.flatnonzero(np.concatenate([[True], first[1:] != last[:-1] + 1]))
    return first[begin], last[np.append(begin[1:], len(first)) - 1]


def _cuts(points: DataFrame, z: Column, total: int, part_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Where parts begin, and into how many blocks each part is dealt: a place with so
    many points that several quantiles fall on it gets as many."""
    n = min(MOST_PARTS, -(-total // part_rows))
    if n < 2:
        return np.zeros(0, np.int64), np.ones(1, np.int64)
    shares = [i / n for i in range(1, n)]
    quantiles = points.agg(F.percentile_approx(z, shares, F.lit(max(10_000, 10 * n))).alias("z")).first().z
    begin, times = np.unique(np.array(quantiles, np.int64), return_counts=True)
    blocks = np.append(1, times)
    return begin, np.maximum(blocks, -(-total // (part_rows * n)))


def _dealt(boxes: DataFrame, begin: np.ndarray, blocks: np.ndarray, cells: int, q_type: str) -> DataFrame:
    """A row per range of a box, part that it meets and block of that."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("_i0", "_i1", "_j0", "_j1")]
            for row in range(batch.num_rows):
                first, last = ranges_of(*(int(e[row]) for e in ends), cells)
                low, high = np.searchsorted(begin, first, "right"), np.searchsorted(begin, last, "right")
                count = high - low + 1
                part = np.repeat(low - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
                at = np.repeat(np.arange(len(first)), count)
                copies = blocks[part]
                block = np.arange(int(copies.sum())) - np.repeat(np.cumsum(copies) - copies, copies)
                at, part = np.repeat(at, copies), np.repeat(part, copies)
                for a in range(0, len(at), _BATCH):
                    some = slice(a, a + _BATCH)
                    given = batch.slice(row, 1).take(pa.array(np.zeros(len(at[some]), np.int64)))
                    yield pa.RecordBatch.from_arrays(
                        [given.column("q"), *map(given.column, _CORNERS), pa.array(part[some]), pa.array(block[some]),
                         pa.array(first[at[some]]), pa.array(last[at[some]])], names=["q", *_CORNERS, *_RANGE])

    kind = f"q {q_type}, " + ", ".join(f"{c} double" for c in _CORNERS) + ", " + ", ".join(f"{c} bigint" for c in _RANGE)
    return boxes.mapInArrow(scan, kind)


def _merged(columns: list[str]):
    """Over rows sorted by part and block, ranges before points, and place: the hits."""

    def hits(points: pa.RecordBatch, ranges: dict) -> Iterator[pa.RecordBatch]:
        z, x, y = (points.column(c).to_numpy(zero_copy_only=False) for c in ("_z", "x", "y"))
        low = np.searchsorted(z, ranges["_z"], "left")
        count = np.searchsorted(z, ranges["_last"], "right") - low
        done = np.cumsum(count)
        for a, b in _runs(done, _BATCH):
            n = count[a:b]
            which = np.repeat(np.arange(a, b), n)
            at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n - low[a:b], n)
            inside = (
                (x[at] > ranges["_xmin"][which]) & (x[at] < ranges["_xmax"][which])
                & (y[at] > ranges["_ymin"][which]) & (y[at] < ranges["_ymax"][which]))
            at, which = pa.array(at[inside]), pa.array(which[inside])
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [ranges["q"].take(which), *[points.column(c).take(at) for c in columns]], names=["q", *columns])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, ranges = None, [], None
        for batch in batches:
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("_part", "_block")]
            tag = batch.column("_tag").to_numpy(zero_copy_only=False)
            change = np.zeros(batch.num_rows, bool)
            change[:1] = True
            for k in (*keys, tag):
                change[1:] |= k[1:] != k[:-1]
            cuts = [*np.flatnonzero(change).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                here = int(keys[0][a]), int(keys[1][a])
                if here != place:
                    place, held, ranges = here, [], None
                if tag[a] == 0:
                    held.append(batch.slice(a, b - a))
                elif held:
                    if ranges is None:
                        table = pa.Table.from_batches(held).combine_chunks()
                        ranges = {c: table.column(c).to_numpy() for c in ("_z", "_last", *_CORNERS)}
                        ranges["q"] = table.column("q").combine_chunks()
                    yield from hits(batch.slice(a, b - a), ranges)

    return scan


def _runs(done: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of ranges with about ``most`` candidates each, one range at least."""
    a = 0
    while a < len(done):
        before = done[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(done, before + most, "right")))
        if done[b - 1] > before:
            yield a, b
        a = b


def batch_box_ranges(points: DataFrame, boxes: DataFrame, *, part_rows: int = PART_ROWS, cells: int = CELLS) -> DataFrame:
    """``batch_box`` for boxes of mixed sizes: ``q`` and the point, for every point strictly
    inside every box. Each point is shuffled once.

    A box is cut into at most ``(cells + 1) ** 2`` cells, and copied to the parts of the
    curve that these touch. A part has about ``part_rows`` points, also where a third of
    all lie in one place; it is streamed, and only its ranges are held. The points are
    read for their extent, for the quantiles, and for the answer."""
    points = scanned(without_tiles(points).where(is_finite()))
    output = _checked(points)
    ends = points.agg(
        *[f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("low", F.min), ("high", F.max))], F.count(F.lit(1)).alias("n")).first()
    span = {c: (ends[f"low{c}"] or 0.0, ends[f"high{c}"] or 0.0) for c in "xy"}
    steps = [_lattice(F.col(c), *span[c]) for c in "xy"]
    z = _spread(steps[0]).bitwiseOR(F.shiftleft(_spread(steps[1]), 1))
    begin, blocks = _cuts(points, z, ends.n, max(1, part_rows))

    @F.arrow_udf("struct<_part:bigint,_block:bigint>")
    def place(z: pa.Array, number: pa.Array) -> pa.Array:
        part = np.searchsorted(begin, z.to_numpy(), "right")
        mixed = (number.to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        block = (mixed % blocks[part].astype(np.uint64)).astype(np.int64)
        return pa.StructArray.from_arrays([pa.array(part.astype(np.int64)), pa.array(block)], names=["_part", "_block"])

    located = points.withColumn("_z", z).withColumn("_at", place("_z", F.monotonically_increasing_id()))
    located = located.select(*output, "_at.*", "_z", F.lit(1).alias("_tag"))
    known = " AND ".join(f"{c} IS NOT NULL" for c in ("x0", "y0", "x1", "y1"))
    queries = boxes.where(known).select("q", *[
        f(f"{c}0", f"{c}1").cast("double").alias(f"_{c}{m}") for f, m in ((F.least, "min"), (F.greatest, "max")) for c in "xy"])
    for c in "xy":
        low, high = F.col(f"_{c}min"), F.col(f"_{c}max")
        # Only boxes that reach into the extent of the points have ranges.
        queries = queries.where((high > low) & (low < F.lit(span[c][1])) & (high > F.lit(span[c][0])))
    queries = queries.select(
        "q", *_CORNERS, _lattice(F.col("_xmin"), *span["x"]).alias("_i0"), _lattice(F.col("_xmax"), *span["x"]).alias("_i1"),
        _lattice(F.col("_ymin"), *span["y"]).alias("_j0"), _lattice(F.col("_ymax"), *span["y"]).alias("_j1"))
    dealt = _dealt(queries, begin, blocks, max(1, cells), boxes.schema["q"].dataType.simpleString())
    rows = dealt.withColumn("_tag", F.lit(0)).unionByName(located, allowMissingColumns=True)
    rows = rows.repartition("_part", "_block").sortWithinPartitions("_part", "_block", "_tag", "_z")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(_merged(output), ", ".join(f"`{c}` {kinds[c]}" for c in ("q", *output)))
