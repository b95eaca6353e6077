"""Landed points: same rows, clustered, prunable."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

import brute
import planar
from planar.sources.landing import TILE_X, z_order

POINTS = brute.scattered(400, 7, hot_share=0.34, span=60.0) + [(900, None, 1.0), (901, 1.0, None), (902, -9999.5, 9999.5)]


def rows(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("tile", [None, 8.0])
@pytest.mark.parametrize("files", [None, 3])
def test_round_trip(spark, tmp_path, tile, files):
    df = spark.createDataFrame(POINTS, "id BIGINT, x DOUBLE, y DOUBLE").withColumn("note", F.lit("n"))
    landed = planar.land_points(df, str(tmp_path / "t"), tile=tile, files=files)
    assert rows(planar.box_query(landed, -1e5, -1e5, 1e5, 1e5)) == rows(planar.box_query(df, -1e5, -1e5, 1e5, 1e5))
    assert rows(landed.select("id", "x", "y", "note")) == rows(df)
    again = planar.read_landed(spark, str(tmp_path / "t"), tile=tile)
    assert rows(again.select("id", "x", "y", "note")) == rows(df)


def test_copies_without_an_id(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2.0)] * 50 + [(3.0, None)] * 2 + [(4.0, 5.0)], "x DOUBLE, y DOUBLE")
    assert rows(planar.land_points(df, str(tmp_path / "t"))) == rows(df)


def test_hot_place_spreads_over_files(spark, tmp_path):
    df = spark.range(40_000).selectExpr("id", "IF(id % 3 = 0, 1D, id / 100D) AS x", "IF(id % 3 = 0, 1D, id / 100D) AS y")
    landed = planar.land_points(df, str(tmp_path / "t"), files=8)
    per_file = landed.groupBy(F.input_file_name()).count().collect()
    assert len(per_file) == 8 and max(r["count"] for r in per_file) < 10_000


def test_every_operator_accepts_tiles(spark, tmp_path):
    df = spark.createDataFrame(POINTS, "id BIGINT, x DOUBLE, y DOUBLE")
    landed = planar.land_points(df, str(tmp_path / "t"), tile=16.0)
    assert rows(planar.circle_query(landed, 10, 20, 9)) == rows(planar.circle_query(df, 10, 20, 9))
    assert rows(planar.knn(landed, 3, 3, 9)) == rows(planar.knn(df, 3, 3, 9))
    assert rows(planar.distance_join(landed, landed, 1)) == rows(planar.distance_join(df, df, 1))
    centres = spark.createDataFrame([(1, 3.0, 3.0)], "q BIGINT, x DOUBLE, y DOUBLE")
    assert rows(planar.batch_circle(landed, centres, 9)) == rows(planar.batch_circle(df, centres, 9))
    assert rows(planar.batch_knn(landed, centres, 4)) == rows(planar.batch_knn(df, centres, 4))
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 9.0, 9.0)], "q BIGINT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE")
    assert rows(planar.batch_box(landed, boxes)) == rows(planar.batch_box(df, boxes))
    assert TILE_X not in planar.box_query(landed, 0, 0, 1, 1).columns


def test_tile_must_be_a_power_of_two(spark, tmp_path):
    with pytest.raises(ValueError):
        planar.land_points(spark.range(1).selectExpr("1D AS x", "1D AS y"), str(tmp_path / "t"), tile=10.0)


def test_z_order_interleaves(spark):
    step = 32768.0 / (1 << 31)
    df = spark.createDataFrame([(3, 5), (0, 0), (1, 0), (0, 1)], "i INT, j INT")
    x, y = F.col("i") * F.lit(step) - 16384.0, F.col("j") * F.lit(step) - 16384.0
    assert [r[0] for r in df.select(z_order(x, y)).collect()] == [0b100111, 0, 1, 2]


def test_landing_returns_what_it_got(spark, tmp_path):
    """Also values that are equal without being identical, infinite places, NULLs."""
    df = spark.sql("""
        SELECT x, 1D AS y, t COLLATE UTF8_LCASE AS t FROM VALUES
        (0D, 'A'), (-0D, 'a'), (0D, 'a'), (0D, 'a'), (double('inf'), 'i'), (1e300D, 'l'), (NULL, 'n'), (double('nan'), 'n') AS r(x, t)""")
    key = lambda d: sorted(map(str, d.selectExpr("cast(x AS STRING)", "y", "cast(t AS BINARY)").collect()))
    for i, tile in enumerate((None, 8.0)):
        landed = planar.land_points(df, str(tmp_path / f"t{i}"), tile=tile)
        assert key(landed) == key(df)
    assert planar.box_query(landed, -1e308, 0, 1e308, 2).count() == 5


def test_another_tile_width_reads_the_same(spark, table, tmp_path):
    rows = brute.scattered(500, 3)
    path = str(tmp_path / "tiles")
    planar.land_points(table(rows), path, tile=8.0)
    want = planar.circle_query(table(rows), 1, 10, 40).count()
    for tile in (8.0, 64.0):
        assert planar.circle_query(planar.read_landed(spark, path, tile=tile), 1, 10, 40).count() == want > 0
