"""Point tables derived from the id columns of a test data folder.

The test tables hold no coordinates, so both are computed from the id. Written
as SQL text, because the same text has to run in the checking engine too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Spread out in steps of 0.01, and steps of 0.5 on few distinct points.
FINE_X = "CAST((id*id*31 + id*7919) % 36000 AS DOUBLE)/CAST(100 AS DOUBLE) - CAST(180 AS DOUBLE)"
FINE_Y = "CAST((id*id*17 + id*104729) % 18000 AS DOUBLE)/CAST(100 AS DOUBLE) - CAST(90 AS DOUBLE)"
SNAP_X = "CAST((id*id*31 + id*7919) % 720 AS DOUBLE)/CAST(2 AS DOUBLE) - CAST(180 AS DOUBLE)"
SNAP_Y = "CAST((id*id*id*13 + id*id*7 + id*29) % 360 AS DOUBLE)/CAST(2 AS DOUBLE) - CAST(90 AS DOUBLE)"

# The same values without an overflow of the third power, which ids beyond 892,000 have:
# the sum has the id's sign, and its remainder follows from the id's.
SNAP_Y_REDUCED = SNAP_Y.replace("id", "(id % 360)")

# Column with the id, and its stored type: a given schema saves the job that
# would read it from a file.
ID_COLUMN = {"events": "event_id", "supplier": "s_suppkey", "nation": "n_nationkey"}
ID_TYPE = {"events": "BIGINT", "supplier": "BIGINT", "nation": "INT"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = f"{ID_COLUMN[name]} {ID_TYPE[name]}"
    return spark.read.schema(schema).parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str, name: str = "events", recipe: str = "fine") -> DataFrame:
    x, y = (FINE_X, FINE_Y) if recipe == "fine" else (SNAP_X, SNAP_Y_REDUCED)
    ids = table(spark, sf_dir, name).select(F.col(ID_COLUMN[name]).cast("bigint").alias("id"))
    return ids.selectExpr("id", f"{x} AS x", f"{y} AS y")


def points_sql(name: str = "events", recipe: str = "fine") -> str:
    x, y = (FINE_X, FINE_Y) if recipe == "fine" else (SNAP_X, SNAP_Y)
    ids = f"SELECT CAST({ID_COLUMN[name]} AS BIGINT) AS id FROM {name}"
    return f"(SELECT id, {x} AS x, {y} AS y FROM ({ids}) ids)"


# 25 query boxes, 18 wide and 9 high.
BOX_X0 = "CAST(-180 AS DOUBLE) + CAST(n_nationkey*14 AS DOUBLE)"
BOX_Y0 = "CAST(-90 AS DOUBLE) + CAST((n_nationkey*37) % 150 AS DOUBLE)"
BOXES_SELECT = (
    f"SELECT CAST(n_nationkey AS BIGINT) AS q, {BOX_X0} AS x0, {BOX_Y0} AS y0, "
    f"{BOX_X0} + CAST(18 AS DOUBLE) AS x1, {BOX_Y0} + CAST(9 AS DOUBLE) AS y1 FROM "
)


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(BOXES_SELECT + "{nation}", nation=table(spark, sf_dir, "nation"))


def boxes_sql() -> str:
    return f"({BOXES_SELECT}nation)"


def centres(spark: SparkSession, sf_dir: str, recipe: str = "fine") -> DataFrame:
    return points(spark, sf_dir, "supplier", recipe).withColumnRenamed("id", "q")
