from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[*]")
        .appName("planar-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def table(spark, tmp_path_factory):
    """A small Parquet table, whose size Spark can estimate."""

    def make(rows, schema="id BIGINT, x DOUBLE, y DOUBLE"):
        path = str(tmp_path_factory.mktemp("table") / "t")
        spark.createDataFrame(rows, schema).write.parquet(path)
        return spark.read.schema(schema).parquet(path)

    return make
