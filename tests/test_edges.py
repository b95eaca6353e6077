"""Hand-made points: edges, exact distances, ties, copies, NULL, bad text."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import brute
import planar

INF, NAN = float("inf"), float("nan")
POINTS = [
    (1, 0.0, 0.0), (2, 3.0, 4.0), (3, 6.0, 8.0), (4, -180.0, 90.0), (5, 180.0, -90.0), (6, 18.0, 9.0),
    (7, 0.0, 4.5), (8, 9.0, 4.5), (9, 9.0, 4.5), (10, None, 1.0), (11, 10.0, 0.0), (12, 9999.5, 0.0),
]


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame(POINTS, "id BIGINT, x DOUBLE, y DOUBLE").cache()


def ids(df):
    return [r.id for r in df.select("id").collect()]


def test_box_excludes_its_edge(points):
    assert sorted(ids(planar.box_query(points, 0, 0, 18, 9))) == [2, 3, 8, 9]


def test_box_corners_in_any_order(points):
    assert sorted(ids(planar.box_query(points, 18, 9, 0, 0))) == [2, 3, 8, 9]


@pytest.mark.parametrize("radius, expected", [(5, [1, 7]), (10, [1, 2, 7]), (0, []), (1e-200, [1])])
def test_circle_is_strict(points, radius, expected):
    assert sorted(ids(planar.circle_query(points, 0, 0, radius))) == expected


@pytest.mark.parametrize("method", ["scan", "narrow"])
def test_knn_orders(points, method):
    assert ids(planar.knn(points, 0, 0, 4, method=method)) == [1, 7, 2, 3]
    assert ids(planar.knn(points, 0, 0, 3, "farthest", method)) == [12, 4, 5]


@pytest.mark.parametrize("method", ["scan", "narrow"])
def test_knn_with_fewer_points_than_k(points, method):
    assert len(ids(planar.knn(points, 0, 0, 100, method=method))) == 11


@pytest.mark.parametrize("order", ["nearest", "farthest"])
@pytest.mark.parametrize("method", ["scan", "narrow"])
def test_nan_is_no_location(spark, order, method):
    rows = [(1, 1.0, 1.0), (2, NAN, 0.0), (3, 2.0, NAN), (4, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "id BIGINT, x DOUBLE, y DOUBLE")
    assert sorted(ids(planar.knn(df, 0, 0, 10, order, method))) == [1, 4]
    assert planar.circle_query(df, 0, 0, 100).count() == 2
    assert planar.distance_join(df, df, 100, strategy="shuffle").count() == 4


@pytest.mark.parametrize("order", ["nearest", "farthest"])
@pytest.mark.parametrize("method", ["scan", "narrow"])
def test_knn_of_nothing(spark, order, method):
    df = spark.createDataFrame([(1, None, 1.0)], "id BIGINT, x DOUBLE, y DOUBLE")
    assert ids(planar.knn(df, 0, 0, 10, order, method)) == []


@pytest.mark.parametrize("order", ["nearest", "farthest"])
@pytest.mark.parametrize("k", [1, 3, 50, 170, 400])
def test_narrow_knn_with_many_copies(spark, order, k):
    rows = brute.scattered(300, 11, hot_share=0.34)
    df = spark.createDataFrame(rows, "id BIGINT, x DOUBLE, y DOUBLE").repartition(7)
    for centre in ((10.0, 20.0), (0.3, -7.0)):
        want = brute.nearest(rows, centre, k, order == "farthest")
        got = planar.knn(df, *centre, k, order, "narrow").collect()
        assert [(r.distance, r.id) for r in got] == want


def test_knn_without_id(spark):
    df = spark.createDataFrame([(1.0, 1.0), (0.0, 2.0), (2.0, 0.0)], "x DOUBLE, y DOUBLE")
    got = [(r.x, r.y) for r in planar.knn(df, 0, 0, 3).collect()]
    assert got == [(1.0, 1.0), (0.0, 2.0), (2.0, 0.0)]


def test_arguments_are_checked(points):
    with pytest.raises(ValueError):
        planar.knn(points, 0, 0, 1, order="closest")
    with pytest.raises(ValueError):
        planar.distance_join(points, points, 1, strategy="magic")
    with pytest.raises(ValueError):
        planar.distance_join(points, points, 1, prefixes=("a_", "a_"))
    with pytest.raises(ValueError):
        planar.publish(points, "v", scope="planet")


def test_bad_text_becomes_null(spark, tmp_path):
    lines = ["1.5,2.5", "-180.0,90.0,extra", "abc,3", ",4", "12345.5,1", "1e2,-7", '" 3.25 ",4', "NaN,5"]
    (tmp_path / "points.csv").write_text("\n".join(lines) + "\n")
    got = [tuple(r) for r in planar.read_csv_points(spark, str(tmp_path / "points.csv")).collect()]
    assert got == [
        (1.5, 2.5), (-180.0, 90.0), (None, 3.0), (None, 4.0), (None, 1.0), (100.0, -7.0), (3.25, 4.0), (None, 5.0),
    ]


def test_points_from_any_columns(spark):
    df = spark.createDataFrame([("a", 1.25, "2.5", 9)], "k STRING, lon DOUBLE, lat STRING, extra INT")
    got = planar.points_from(df, "lon", F.col("lat"), "k", keep=["extra"])
    assert got.columns == ["id", "x", "y", "extra"]
    assert got.collect()[0] == ("a", 1.25, 2.5, 9)


def test_coord_rounds_to_twenty_digits(spark):
    df = spark.sql("SELECT 1e-25D AS tiny, 0.1D AS tenth, double('inf') AS big")
    row = df.select(planar.coord("tiny").alias("t"), planar.coord("tenth").alias("p"), planar.coord("big").alias("b"))
    assert row.collect()[0] == (0.0, 0.1, None)


def test_views(spark, points):
    planar.publish(planar.circle_query(points, 0, 0, 5), "circle_rows")
    assert spark.sql("SELECT count(*) FROM CIRCLE_ROWS").first()[0] == 2
    planar.publish(planar.circle_query(points, 0, 0, 5), "circle_rows_all", scope="global")
    assert spark.newSession().sql("SELECT count(*) FROM global_temp.circle_rows_all").first()[0] == 2
