"""The physical plans that make the operators scale."""

from __future__ import annotations

import pytest

import planar
from planar import fixtures

SF_DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    points = fixtures.points(spark, SF_DIR).selectExpr("*", "'note' AS note")
    return planar.land_points(points, str(tmp_path_factory.mktemp("landed") / "t"), tile=64.0)


def test_box_is_pushed_and_pruned(landed):
    text = plan(planar.box_query(landed, 0, 0, 18, 9).select("id"))
    assert "GreaterThan(x,0.0), LessThan(x,18.0), GreaterThan(y,0.0), LessThan(y,9.0)" in text
    assert "ReadSchema: struct<id:bigint,x:double,y:double>" in text
    assert "PartitionFilters" in text and "tile_x" in text.split("PartitionFilters")[1].splitlines()[0]
    assert "Exchange" not in text


def test_circle_pushes_its_bounding_box(landed):
    text = plan(planar.circle_query(landed, -118, 62, 20))
    assert "GreaterThanOrEqual(x,-138.0), LessThanOrEqual(x,-98.0)" in text
    assert "Exchange" not in text


def test_sql_text_is_pushed(spark, landed):
    planar.register(spark)
    query = """SELECT id FROM {t}
        WHERE ST_Contains(ST_PolygonFromEnvelope(-180.0, 0.0, 0.0, 136.0), ST_Point(x, y))"""
    text = plan(spark.sql(query, t=landed))
    assert "GreaterThan(x,-180.0), LessThan(x,0.0)" in text and "PythonUDF" not in text


def test_knn_is_a_top_k_per_task(landed):
    text = plan(planar.knn(landed, 0, 0, 10))
    assert "TakeOrderedAndProject" in text and "Exchange" not in text and "Sort " not in text


def test_narrow_knn_limits_the_scan(landed):
    text = plan(planar.knn(landed, 20, 20, 10, method="narrow"))
    assert "WindowGroupLimit" in text and "Partial" in text
    assert "GreaterThanOrEqual(x," in text and "LessThanOrEqual(y," in text
    assert "tile_x" in text.split("PartitionFilters")[1].splitlines()[0]


@pytest.mark.parametrize("options, join", [({}, "BroadcastHashJoin"), ({"strategy": "shuffle"}, "SortMergeJoin")])
def test_joins_are_equi_joins(spark, landed, options, join):
    right = fixtures.points(spark, SF_DIR, "supplier")
    centres = right.withColumnRenamed("id", "q")
    for df in (
        planar.distance_join(landed, right, 10, **options),
        planar.batch_circle(landed, centres, 10, **options),
        planar.batch_box(landed, fixtures.boxes(spark, SF_DIR), **options),
        planar.batch_knn(landed, centres, 10, **options),
    ):
        text = plan(df)
        assert join in text and "NestedLoop" not in text and "Cartesian" not in text


def test_hot_cells_are_cut_into_blocks(landed):
    text = plan(planar.distance_join(landed, landed, 10, strategy="shuffle", block_rows=2))
    assert "_block" in text and "_hot" in text
    calm = plan(planar.distance_join(landed, landed, 10, strategy="shuffle"))
    assert "_block" not in calm and "_hot" not in calm


def test_batch_knn_ranks_before_the_shuffle(spark, landed):
    text = plan(planar.batch_knn(landed, fixtures.centres(spark, SF_DIR), 10))
    assert "Partial" in text.split("WindowGroupLimit", 1)[1]


def test_batch_counts_combine_before_the_shuffle(spark, landed):
    text = plan(planar.batch_box_count(landed, fixtures.boxes(spark, SF_DIR)))
    assert "partial_count" in text and "note" not in text
