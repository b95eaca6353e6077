"""Point tables from CSV text or from any DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planar.functions.exprs import coord


def read_raw_csv(spark: SparkSession, path: str | Sequence[str], columns: int = 2) -> DataFrame:
    """Headerless CSV as strings ``_c0``, ``_c1``, ...; the schema is given, so
    no file is read to find it. Further columns in the file are ignored. The
    path may use any file system Spark is configured for."""
    fields = [T.StructField(f"_c{i}", T.StringType()) for i in range(columns)]
    paths = path if isinstance(path, str) else list(path)
    return spark.read.schema(T.StructType(fields)).csv(paths, header=False)


def points_from(
    df: DataFrame,
    x: Column | str = "x",
    y: Column | str = "y",
    id: Column | str | None = None,  # noqa: A002
    keep: Sequence[str] = (),
) -> DataFrame:
    """Point table from two columns of any type, for example of a connector.

    ``id``, if given, must be unique; it breaks ties and lets joins split hot
    places without folding copies. Rows whose coordinates are no numbers or too
    wide stay in the table with NULL coordinates and match no query.
    """
    columns = [] if id is None else [(F.col(id) if isinstance(id, str) else id).alias("id")]
    columns += [coord(x).alias("x"), coord(y).alias("y")]
    return df.select(*columns, *keep)


def read_csv_points(
    spark: SparkSession,
    path: str | Sequence[str],
    x: int = 0,
    y: int = 1,
    id: int | None = None,  # noqa: A002
) -> DataFrame:
    """Points from headerless CSV, by column position."""
    used = [x, y] if id is None else [x, y, id]
    raw = read_raw_csv(spark, path, columns=max(used) + 1)
    key = None if id is None else F.col(f"_c{id}").try_cast("bigint")
    return points_from(raw, f"_c{x}", f"_c{y}", key)
