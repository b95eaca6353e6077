"""Consecutive numbers and running sums within large groups.

One range shuffle sorts all rows, so a group that holds most of them lies in many tasks.
What a row has before it is what it has before it in its task, and what the group has in
earlier tasks; only the totals per task and group are summed. Rows that agree in the whole
order are told apart by their number in the scan: the input must come from a scan without a
shuffle. Results are on sorted rows that were written, so they do not change afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planar.llm.joins import attach
from planar.llm.scratch import written


def _sorted(df: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """With ``_row``, the place in the result, and ``_task``."""
    keys = [F.col(c).asc_nulls_first() for c in (group, *order, "_row")]
    rows = df.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    return rows.withColumns({"_row": F.monotonically_increasing_id(), "_task": F.spark_partition_id()})


def _earlier(runs: DataFrame, group: str, values: Sequence[str]) -> DataFrame:
    """``values`` of a group's earlier tasks, for runs with ``_task`` and ``_first``."""
    window = Window.partitionBy(group).orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumns({v: F.coalesce(F.sum(v).over(window), F.lit(0)) for v in values})


def ranked(df: DataFrame, group: str, order: Sequence[str], label: str) -> DataFrame:
    """``df`` with ``pos``, 0 and up within each value of ``group`` (not NULL), by
    ``order`` with NULLs first. Built-in expressions only."""
    rows = written(df.sparkSession, _sorted(df, group, order), label)
    runs = rows.groupBy("_task", group).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    runs = _earlier(runs, group, ["_n"]).select("_task", group, (F.col("_n") - F.col("_first")).alias("_shift"))
    out = attach(rows, written(df.sparkSession, runs, f"{label}-runs"), ["_task", group], "inner")
    return out.withColumn("pos", F.col("_row") + F.col("_shift")).select(*df.columns, "pos")


def running(df: DataFrame, group: str, order: Sequence[str], values: dict[str, str], label: str) -> DataFrame:
    """``df`` with, for each new column in ``values``, the sum of the BIGINT column it
    stands for over the rows before in the group, ordered as in ``ranked``."""
    new, given = list(values), list(values.values())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, np.zeros(len(given), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(group)
            if isinstance(keys, pa.ChunkedArray):
                keys = keys.combine_chunks()
            code = keys.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            begin = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            size = np.diff(np.append(begin, len(code)))
            same = keys[0].as_py() == last
            columns = []
            for i, name in enumerate(given):
                v = batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)
                upto = np.cumsum(v) - v
                out = upto - np.repeat(upto[begin], size)
                if same:
                    out[: size[0]] += carried[i]
                columns.append(pa.array(out))
                carried[i] = out[-1] + v[-1]
            last = keys[-1].as_py()
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *new])

    rows = _sorted(df, group, order)
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    rows = rows.mapInArrow(scan, kind + "".join(f", `{n}` bigint" for n in new))
    rows = written(df.sparkSession, rows, label)
    totals = [F.sum(v).alias(f"_s{i}") for i, v in enumerate(given)]
    runs = rows.groupBy("_task", group).agg(F.min("_row").alias("_first"), *totals)
    names = [f"_s{i}" for i in range(len(given))]
    runs = written(df.sparkSession, _earlier(runs, group, names).select("_task", group, *names), f"{label}-runs")
    out = attach(rows, runs, ["_task", group], "inner")
    return out.select(*df.columns, *[(F.col(n) + F.col(s)).alias(n) for n, s in zip(new, names)])
