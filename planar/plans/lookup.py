"""Looking rows up in a table that has each key once, also where a third of the rows
ask for one key."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planar.plans.scratch import stored
from planar.plans.sizing import fits_broadcast

# A key with more rows than this is dealt to several tasks.
HOT_ROWS = 200_000


def attach(
    rows: DataFrame, small: DataFrame, keys: str | Sequence[str], how: str = "left", hot_rows: int = HOT_ROWS,
    *, fits: Callable[[DataFrame], bool] | None = None,
) -> DataFrame:
    """Join ``small``, which has each key once, to ``rows``, which come from a scan
    without a shuffle: a broadcast if it was measured to fit one (or ``fits`` says so). Else the rows are
    counted per key, and a key with more than ``hot_rows`` gets so many parts that none
    has more; a row's part follows from its number in the scan, and ``small`` has such
    a key once for each part. There are at most ``rows / hot_rows`` such keys.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    if (fits or fits_broadcast)(small):
        return rows.join(F.broadcast(small), keys, how)
    parts = F.ceil(F.col("_n") / F.lit(hot_rows)).alias("_parts")
    hot = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows).select(*keys, parts)
    hot = stored(hot, "hot-keys")
    if hot.isEmpty():
        return rows.join(small.hint("merge"), keys, how)
    hot = F.broadcast(hot) if fits_broadcast(hot) else hot
    one = F.coalesce("_parts", F.lit(1))
    salt = F.pmod(F.xxhash64("_row"), one)
    salted = rows.withColumn("_row", F.monotonically_increasing_id()).join(hot, keys, "left").withColumn("_salt", salt)
    copies = small.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), one - 1)))
    out = salted.drop("_row", "_parts").join(copies.drop("_parts").hint("merge"), [*keys, "_salt"], how)
    return out.drop("_salt")
