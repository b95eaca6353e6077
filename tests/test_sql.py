"""The four query shapes as SQL text."""

from __future__ import annotations

import pytest

import brute
import planar

A, B = brute.scattered(80, 8), brute.scattered(40, 9)


@pytest.fixture(scope="module", autouse=True)
def views(spark):
    planar.register(spark)
    for name, column, rows in (("spots", "p", A), ("spots_2", "p_2", B)):
        df = spark.createDataFrame([(i, str(x), str(y)) for i, x, y in rows], "id BIGINT, _c0 STRING, _c1 STRING")
        df.createOrReplaceTempView("raw")
        spark.sql(
            f"""SELECT id, ST_Point(CAST(_c0 AS DECIMAL(24,20)), CAST(_c1 AS DECIMAL(24,20))) AS {column} FROM raw"""
        ).createOrReplaceTempView(name)


def test_box(spark):
    got = spark.sql("SELECT * FROM SPOTS WHERE ST_Contains(ST_PolygonFromEnvelope(2.0, 3.0, 11.5, 12), p)")
    assert sorted(r.id for r in got.collect()) == [i for i, x, y in A if 2 < x < 11.5 and 3 < y < 12]


def test_circle(spark):
    got = spark.sql("SELECT * FROM spots WHERE ST_Distance(ST_Point(10.0, 10.0), p) < 5")
    assert sorted(r.id for r in got.collect()) == [p[0] for p in A if brute.dist(p[1:], (10, 10)) < 5]


def test_top_k(spark):
    got = spark.sql("SELECT id, ST_Distance(ST_Point(1, 100), p) AS distance FROM spots ORDER BY distance DESC LIMIT 5")
    assert [r.id for r in got.collect()] == [i for _, i in brute.nearest(A, (1, 100), 5, farthest=True)]


@pytest.mark.parametrize("radius", [0.1, 1, 10])
def test_join_text_and_grid_form(spark, radius):
    plain = spark.sql(f"SELECT * FROM spots, spots_2 WHERE ST_Distance(spots.p, spots_2.p_2) < {radius}")
    grid = spark.sql(f"""
        SELECT a.*, b.p_2 FROM spots a
        JOIN (SELECT *, explode(cells) AS cell FROM (SELECT *, grid_cells(p_2, {radius}) AS cells FROM spots_2)) b
          ON grid_cell(a.p, {radius}) = b.cell AND ST_Distance(a.p, b.p_2) < {radius}""")
    assert plain.count() == grid.count() == sum(brute.pairs(A, B, radius).values())
    assert "NestedLoop" not in grid._jdf.queryExecution().executedPlan().toString()
