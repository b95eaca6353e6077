"""Cutting hot join keys into blocks.

A cell may hold a third of all rows. Such a cell is cut into ``a x b`` blocks:
a row of the left side goes to one of ``a`` row blocks and is copied to the
``b`` column blocks, a row of the right side the other way round. Every pair
still meets exactly once, and no task sees more than about ``block_rows`` rows
of either side of a cell.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planar.plans.grid import CELL, LEVEL
from planar.plans.scratch import stored
from planar.plans.sizing import estimated_bytes, fits_broadcast, scans_few

BLOCK_ROWS = 50_000
# Blocks of all cells: at most so many per shuffle partition, but so many in any case.
_PARTITION_BLOCKS, _FREE_BLOCKS = 16, 4_096
# Tasks per core of rows that are spread by place: places differ in what they meet.
_PLACE_TASKS = 4
# Of a shuffled join: pairs to compare that are worth a task, and tasks per core at most.
_TASK_PAIRS, _JOIN_TASKS = 1_000_000, 16
# A cell that is cut.
_SEVERAL = "_na > 1 OR _nb > 1"


def counted_cells(big: DataFrame, small: DataFrame, keys: Sequence[str], block_rows: int) -> DataFrame:
    """``keys`` with the number of row blocks ``_na``, of column blocks ``_nb`` and of the pairs
    ``_pairs`` that meet, of every cell that gets several blocks; all other cells are one row
    without keys. Rows are counted per task and cell before they are shuffled; the result
    stays a distributed table, however many such cells there are."""
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    rows = big.select(*keys, one.alias("_a"), none.alias("_b")).unionByName(
        small.select(*keys, none.alias("_a"), one.alias("_b")))
    cells = rows.groupBy(*keys).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b")).select(
        *keys,
        *(F.greatest(F.ceil(F.col(n) / F.lit(block_rows)), one).alias(b) for n, b in (("_a", "_na"), ("_b", "_nb"))),
        (F.col("_a").cast("double") * F.col("_b")).alias("_pairs"),
    )
    several = [F.when(F.expr(_SEVERAL), F.col(k)).alias(k) for k in keys]
    return cells.groupBy(*several, "_na", "_nb").agg(F.sum("_pairs").alias("_pairs"))


def hot_cells(big: DataFrame, small: DataFrame, keys: Sequence[str], block_rows: int) -> DataFrame:
    """``keys, _na, _nb`` of the cells that get several blocks."""
    return counted_cells(big, small, keys, block_rows).where(_SEVERAL).drop("_pairs")


def join_tasks(cells: DataFrame) -> int | None:
    """Into how many tasks to shuffle a join, given its ``counted_cells``. Spark makes few tasks
    of few bytes, whatever comes of them: so many that the cores share the pairs evenly.
    None if the pairs are too few for that to matter."""
    session = cells.sparkSession
    pairs = cells.agg(F.sum("_pairs")).first()[0] or 0.0
    partitions, cores = int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism
    tasks = int(min(pairs / _TASK_PAIRS, _JOIN_TASKS * cores))
    return max(tasks, partitions) if tasks >= _PLACE_TASKS * cores else None


def no_more_blocks_than_help(hot: DataFrame) -> DataFrame:
    """``hot`` with larger blocks, if there are many times more than tasks: more of them
    spread the pairs no better, and a row is copied to every block of the other side, so
    that the copies would grow like the pairs. Cells left with one block are not cut."""
    blocks = hot.agg(F.sum(F.col("_na").cast("double") * F.col("_nb"))).first()[0] or 0.0
    partitions = int(hot.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = max(_FREE_BLOCKS, _PARTITION_BLOCKS * partitions)
    if blocks <= most:
        return hot
    larger = F.lit(math.sqrt(blocks / most))
    fewer = hot.withColumns({n: F.ceil(F.col(n) / larger).cast("bigint") for n in ("_na", "_nb")})
    return fewer.where((F.col("_na") > 1) | (F.col("_nb") > 1))


def _kept_order(df: DataFrame) -> DataFrame:
    """Spark drops a sort below a join, unless rows are numbered in between."""
    return df.where(F.monotonically_increasing_id() >= 0)


def spread_by_place(
    df: DataFrame, *places: Column | str, keep: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Over all cores, like ``spread``, but with the rows of a place side by side. They
    meet the same rows, so a join that finds many pairs for each writes fewer bytes.

    That holds for a large scan as well, of which only the rows that ``keep`` leaves are
    shuffled, into as many tasks as other shuffles get."""
    few = scans_few(df)
    if not few and estimated_bytes(df) is None:  # no local JVM to ask
        return df
    session = df.sparkSession
    tasks = _PLACE_TASKS * session.sparkContext.defaultParallelism
    if not few:
        tasks = max(tasks, int(session.conf.get("spark.sql.shuffle.partitions")))
    # The number parts the rows of one hot place.
    rows = scanned(df).withColumn("_number", F.monotonically_increasing_id())
    if keep and not few:
        rows = keep(rows)
    rows = rows.repartitionByRange(tasks, *places, "_number").sortWithinPartitions(*places, "_number")
    return _kept_order(rows.drop("_number"))


def scanned(df: DataFrame) -> DataFrame:
    """``df`` such that a retried task numbers its rows as before: itself if it comes
    straight from a scan, else written to the scratch folder first, because the rows of
    a shuffled table may arrive in another order."""
    plan = getattr(df, "_jdf", None)
    if plan is not None and "Exchange" not in plan.queryExecution().executedPlan().toString():
        return df
    return stored(df, "numbered")


def _to_blocks(
    df: DataFrame, hot: DataFrame, keys: Sequence[str], block: str, rows_first: bool
) -> DataFrame:
    """Draw the own block of a row in a hot cell from its number in the scan, so that
    rows without an id or with the same one spread as well, and copy the row to all
    blocks of the other side. ``block`` gets both numbers in one BIGINT, 0 outside hot
    cells."""
    own_n, other_n = ("_na", "_nb") if rows_first else ("_nb", "_na")
    named = hot.withColumnsRenamed({k: f"_hot{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on &= F.col(k) == F.col(f"_hot{k}")
    own = F.pmod(F.xxhash64(F.col("_pick")), F.col(own_n))
    zero = F.lit(0).cast("bigint")
    others = F.when(F.col(other_n).isNull(), F.array(zero)).otherwise(
        F.sequence(zero, F.coalesce(other_n, F.lit(1)) - 1))
    first, second = (own, F.col("_other")) if rows_first else (F.col("_other"), own)
    both = F.shiftleft(first, 32).bitwiseOR(second)
    return (
        df.withColumn("_pick", F.monotonically_increasing_id())
        .join(named, on, "left")
        .withColumn("_other", F.explode(others))
        .withColumn(block, F.coalesce(both, zero))
        .drop("_pick", "_other", "_na", "_nb", *[f"_hot{k}" for k in keys])
    )


def cell_join(
    big: DataFrame,
    small: DataFrame,
    residual: Column,
    *,
    broadcast: bool,
    block_rows: int = BLOCK_ROWS,
    order: Sequence[str] = (),
) -> DataFrame:
    """Inner equi-join on the cell (and level) with ``residual`` as exact test.

    Both inputs carry ``CELL``, all other column names differ. After a shuffle the rows of
    a cell are sorted by the columns ``order`` of ``big``, and so are the pairs.

    With ``broadcast`` the caller has checked the size of ``small``; ``big`` is
    then not shuffled at all, so its hot cells stay spread over the scan tasks.
    Otherwise the rows per cell of both sides are counted before the join; one with
    ``order`` that compares many pairs gets tasks enough for them.
    """
    s_cell, s_level = "_s" + CELL, "_s" + LEVEL
    keys = [CELL, LEVEL] if LEVEL in big.columns else [CELL]
    # Columns that have to agree besides the cell.
    agree = [(LEVEL, s_level)] if LEVEL in big.columns else []

    if not broadcast:
        cells = stored(counted_cells(big, small, keys, block_rows), "hot-cells")
        tasks = join_tasks(cells) if order else None
        hot = no_more_blocks_than_help(cells.where(_SEVERAL).drop("_pairs"))
        if not hot.isEmpty():
            # Beyond the broadcast limit AQE splits what the cells have in common.
            hot = F.broadcast(hot) if fits_broadcast(hot) else hot
            big = _to_blocks(scanned(big), hot, keys, "_block", True)
            small = _to_blocks(scanned(small), hot, keys, "_s_block", False)
            agree += [("_block", "_s_block")]
    small = small.withColumnsRenamed({CELL: s_cell, LEVEL: s_level})

    # A single BIGINT key sorts by radix and probes a dense hash table, so the
    # other columns are mixed into it. For equal values of those the key is one
    # to one with the cell; that they are equal is tested on the pair, as a
    # difference, which Spark does not turn into further join keys.
    left_key, right_key = F.col(CELL), F.col(s_cell)
    if agree:
        left_key = left_key.bitwiseXOR(F.xxhash64(*[l for l, _ in agree]))
        right_key = right_key.bitwiseXOR(F.xxhash64(*[r for _, r in agree]))
    big = big.withColumn(CELL, left_key)
    if order and not broadcast:
        big = big.repartition(tasks, CELL) if tasks else big.repartition(CELL)
        big = _kept_order(big.sortWithinPartitions(CELL, *order))
    small = small.withColumn(s_cell, right_key)
    on = F.col(CELL) == F.col(s_cell)
    for l, r in agree:
        on &= (F.col(l) - F.col(r)) == F.lit(0)
    internal = [CELL, s_cell, *(c for pair in agree for c in pair)]
    # Without broadcast, the hint keeps Spark from doing so on an estimate that
    # does not see the copies made above.
    small = F.broadcast(small) if broadcast else small.hint("merge")
    return big.join(small, on & residual).drop(*internal)
