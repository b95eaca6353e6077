"""Grid cells as join keys.

Two layouts are used:

* one cell width for a fixed radius (``distance_join``): a point has one cell,
  the replicated side is copied to the 3x3 cells around it;
* power-of-two widths, one level per box size (``batch_box``, ``batch_knn``):
  a box is copied to the few cells it touches on its own level, a point gets
  one cell on every level in use.

A cell is packed into one BIGINT (low 32 bits of each index). Packing may alias
two far-apart cells; the exact test on the pair removes what that lets in, and
the copies of one row sit in adjacent cells, so they never alias each other and
no pair is produced twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = "_cell"
LEVEL = "_level"

# A cell is a little wider than the radius, so that rounding in ``x / width`` can
# never put two points closer than the radius more than one cell apart: by a share
# of the radius and of the largest coordinate that can take part.
CELL_PAD_REL = 1e-9
CELL_PAD_PLACE = 2.0**-46
# For SQL text, which cannot measure: coordinates up to 1e8.
CELL_PAD_ABS = 1e-7

# Widths are finite powers of two; larger boxes than the last get few cells anyway.
MIN_LEVEL, MAX_LEVEL = -20, 1_023
# Levels are rounded up to multiples of this, for fewer copies of each point.
LEVEL_STEP = 2
# Indices stay in this range of a BIGINT; clamping keeps their order.
_MOST_INDEX = float(1 << 62)
_MOST_DOUBLE = 1.7976931348623157e308
# Cells per axis for a circle that the data's extent cuts off.
CUT_PARTS = 32


def cell_width(radius: float, largest: float) -> float:
    """For points up to ``largest`` and all that are closer than ``radius`` to one."""
    return radius * (1.0 + CELL_PAD_REL) + (largest + radius) * CELL_PAD_PLACE


def pack_sql(cx: str, cy: str) -> str:
    return f"(shiftleft({cx}, 32) | ({cy} & 4294967295L))"


def _whole_sql(v: str) -> str:
    """Rounded down to a BIGINT; what does not fit, infinities too, is clamped."""
    return f"floor(least(greatest({v}, {-_MOST_INDEX!r}D), {_MOST_INDEX!r}D))"


def cell_sql(x: str, y: str, width: str) -> str:
    """The cell of a point, as SQL text over BIGINT and DOUBLE expressions."""
    return pack_sql(_whole_sql(f"{x} / {width}"), _whole_sql(f"{y} / {width}"))


def neighbour_cells_sql(x: str, y: str, width: str) -> str:
    """The array of the nine cells within one step."""
    steps = ("-1L", "0L", "1L")
    cells = (
        pack_sql(f"({_whole_sql(f'{x} / {width}')} + {dx})", f"({_whole_sql(f'{y} / {width}')} + {dy})")
        for dx in steps for dy in steps
    )
    return f"array({', '.join(cells)})"


# The cells around which a self join looks: of two neighbours one lies in these of the other.
HALF_STEPS = ((1, -1), (1, 0), (1, 1), (0, 1))


def with_half_neighbour_cells(df: DataFrame, x: str, y: str, width: float, apart: str) -> DataFrame:
    """Five copies per row: its own cell, with ``apart`` false, and half the cells around."""
    index = [_whole_sql(f"`{c}` / {width!r}D") for c in (x, y)]
    cells = [f"struct({pack_sql(*index)} AS {CELL}, false AS {apart})"]
    cells += [
        f"struct({pack_sql(f'({index[0]} + {dx}L)', f'({index[1]} + {dy}L)')} AS {CELL}, true AS {apart})"
        for dx, dy in HALF_STEPS
    ]
    return df.select("*", F.expr(f"inline(array({', '.join(cells)}))"))


def occupied(df: DataFrame) -> DataFrame:
    """``_square, _bits``: the cells of ``df``, 8 x 8 of them in a 64-bit word."""
    return df.groupBy(_square().alias("_square")).agg(F.bit_or(F.expr(f"shiftleft(1L, {_BIT})")).alias("_bits"))


def only_occupied(df: DataFrame, words: DataFrame) -> DataFrame:
    """The rows whose cell is one of ``occupied``."""
    return df.join(words, (_square() == words["_square"]) & F.expr(f"(shiftright(_bits, {_BIT}) & 1L) = 1L"), "left_semi")


# Of a packed cell: its place in its square, and the square.
_BIT = f"CAST((shiftright({CELL}, 32) & 7L) * 8L + ({CELL} & 7L) AS INT)"


def _square() -> Column:
    return F.col(CELL).bitwiseAND(F.lit(~((7 << 32) | 7)))


def with_cell(df: DataFrame, x: str, y: str, width: float) -> DataFrame:
    """One cell per row."""
    return df.withColumn(CELL, F.expr(cell_sql(f"`{x}`", f"`{y}`", f"{width!r}D")))


def with_neighbour_cells(df: DataFrame, x: str, y: str, width: float) -> DataFrame:
    """Nine copies per row, one for each cell within one step."""
    cells = neighbour_cells_sql(f"`{x}`", f"`{y}`", f"{width!r}D")
    return df.withColumn(CELL, F.expr(f"explode({cells})"))


def _level_of(size: Column) -> Column:
    """A power of two that is not below ``size``, as its exponent. A larger one
    changes the number of copies, never the result."""
    exponent = F.coalesce(F.log2(size), F.lit(float(MIN_LEVEL)))
    exponent = F.least(F.greatest(exponent, F.lit(float(MIN_LEVEL))), F.lit(float(MAX_LEVEL)))
    return F.least(F.ceil(exponent / LEVEL_STEP) * LEVEL_STEP, F.lit(MAX_LEVEL)).cast("int")


def _index_sql(v: str) -> str:
    # Dividing by a power of two is exact, so the index never decreases as v grows.
    finite = f"least(greatest({v}, {-_MOST_DOUBLE!r}D), {_MOST_DOUBLE!r}D)"
    return _whole_sql(f"{finite} / pow(2D, {LEVEL})")


def level_index(column: str) -> Column:
    """The index on one axis of the cell that a row with a ``LEVEL`` lies in."""
    return F.expr(_index_sql(f"`{column}`"))


def box_copies(parts: int) -> int:
    """Most copies that ``with_box_cells`` makes of one row."""
    return (parts + 1) ** 2


def with_box_cells(
    df: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column, parts: int | Column = 2,
    circle: tuple[str, str, Column] | None = None,
) -> DataFrame:
    """Copies of each row, one per cell its box touches on the box's level. The
    cell is at least ``1 / parts`` as wide as the box, so there are at most
    ``parts + 1`` per axis; smaller cells let fewer points meet a box in vain.

    With ``circle`` (centre columns and radius) the cells in the corners of the
    box that the circle does not reach are left out.
    """
    df = df.withColumns({"_bx0": x0, "_by0": y0, "_bx1": x1, "_by1": y1})
    size = F.expr("greatest(_bx1 - _bx0, _by1 - _by0)")
    df = df.withColumn(LEVEL, _level_of(size / (parts if isinstance(parts, Column) else F.lit(float(parts)))))
    if circle:
        df = df.withColumn("_reach", circle[2])
    for axis in "xy":
        span = f"sequence({_index_sql(f'_b{axis}0')}, {_index_sql(f'_b{axis}1')})"
        df = df.withColumn(f"_c{axis}", F.expr(f"explode({span})"))
    if circle:
        width = f"pow(2D, {LEVEL})"
        gaps = [
            f"greatest(_c{axis} * {width} - {centre}, {centre} - (_c{axis} + 1) * {width}, 0D)"
            for axis, centre in zip("xy", circle[:2])
        ]
        # Some slack, since the gaps are rounded; a spare cell does no harm.
        reach = f"(_reach * {1.0 + 1e-6!r}D + {CELL_PAD_ABS!r}D + (abs({circle[0]}) + abs({circle[1]})) * 1e-12D)"
        df = df.where(F.expr(" + ".join(f"{g} * {g}" for g in gaps) + f" <= {reach} * {reach}"))
        df = df.drop("_reach")
    df = df.withColumn(CELL, F.expr(pack_sql("_cx", "_cy")))
    return df.drop("_bx0", "_by0", "_bx1", "_by1", "_cx", "_cy")


def with_level_cells(df: DataFrame, x: str, y: str, boxes: DataFrame) -> DataFrame:
    """One cell per row for every level that occurs in ``boxes`` (at most
    ``MAX_LEVEL - MIN_LEVEL + 1`` of them; one when all boxes have one size)."""
    levels = boxes.agg(F.sort_array(F.collect_set(LEVEL)).alias("levels"))
    df = df.withColumn(LEVEL, F.explode(levels.scalar()))
    return df.withColumn(CELL, F.expr(pack_sql(_index_sql(f"`{x}`"), _index_sql(f"`{y}`"))))
