"""Size checks that decide between broadcasting and shuffling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Most memory a broadcast side may take, copies for neighbour cells included.
BROADCAST_BYTES = 64 << 20

_ROW_OVERHEAD = 24
# ``spread`` shuffles at most so many scan tasks' worth, however many cores there are.
_MOST_SPREAD_TASKS = 16
# Catalyst stands in a size near 2^63 for inputs it knows nothing about.
_NO_ESTIMATE = 1 << 50
_FIXED_WIDTH = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
_VARIABLE_WIDTH = (T.StringType, T.BinaryType)


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate; None in sessions without a local JVM."""
    plan = getattr(df, "_jdf", None)
    if plan is None:
        return None
    return int(str(plan.queryExecution().optimizedPlan().stats().sizeInBytes()))


def measured_bytes(df: DataFrame) -> int:
    """Row bytes by counting."""
    fixed, variable = _ROW_OVERHEAD, []
    for field in df.schema.fields:
        if isinstance(field.dataType, _VARIABLE_WIDTH):
            fixed += 16
            variable.append(F.coalesce(F.octet_length(F.col(f"`{field.name}`")), F.lit(0)))
        elif isinstance(field.dataType, _FIXED_WIDTH):
            fixed += 16 if isinstance(field.dataType, T.DecimalType) else 8
        else:  # nested: as long as its text
            variable.append(F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{field.name}`").alias("v")))), F.lit(0)))
    aggs = [F.count(F.lit(1))] + [F.sum(v.cast("bigint")) for v in variable]
    rows, *widths = df.agg(*aggs).first()
    return rows * fixed + sum(w or 0 for w in widths)


def scan_tasks(df: DataFrame) -> int | None:
    """About how many tasks a scan of ``df`` gets."""
    size = estimated_bytes(df)
    if size is None:
        return None
    text = df.sparkSession.conf.get("spark.sql.files.maxPartitionBytes", "128MB").strip().lower()
    digits = text.rstrip("bkmgi")
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(text[len(digits):][:1], 1)
    return size // max(1, int(digits) * unit) + 1


def scans_few(df: DataFrame) -> bool:
    """Whether the scan of ``df`` would use less than a quarter of the cores."""
    tasks = scan_tasks(df)
    # Unknown sizes count as large.
    return tasks is not None and tasks * 4 <= df.sparkSession.sparkContext.defaultParallelism and tasks <= _MOST_SPREAD_TASKS


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """Over all cores, if the input is so small that its scan would use less
    than a quarter of them; for work that costs much more than reading."""
    if not scans_few(df):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if key in df.columns else df.repartition(cores)


def broadcast_copies(df: DataFrame, choices: Sequence[int], limit: int = BROADCAST_BYTES) -> int:
    """The first of ``choices`` (largest first) so that this many copies of every
    row of ``df`` were measured to stay within ``limit``; 0 if none do.

    The measuring job runs only on an input that is already expected to be
    small, by Catalyst's estimate or, where it has none, by taking rows until
    there are too many. The estimate alone is not trusted (compressed files,
    filters, explodes).
    """
    estimate = estimated_bytes(df)
    if estimate is None or estimate >= _NO_ESTIMATE:
        most = limit // (min(choices) * _ROW_OVERHEAD)
        if df.select(F.lit(True)).limit(most + 1).count() > most:
            return 0
    elif estimate > limit:
        return 0
    size = measured_bytes(df)
    return next((n for n in choices if size * n <= limit), 0)


def fits_broadcast(df: DataFrame, copies: int = 1, limit: int = BROADCAST_BYTES) -> bool:
    """True only if ``copies`` of ``df`` were measured to stay within ``limit``."""
    return broadcast_copies(df, [copies], limit) > 0
