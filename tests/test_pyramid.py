"""Batch k nearest and farthest by counts on nested cells."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
import brute
import planar
from planar import fixtures
from planar.operators import batch
from planar.plans import pyramid

INF = float("inf")


def answers(df):
    return sorted((r.q, r.rk, r.distance, r.id) for r in df.collect())


def expected(points, centres, k, order):
    return sorted(
        (c[0], i + 1, d, pid) for c in centres if None not in c
        for i, (d, pid) in enumerate(brute.nearest(points, c[1:], k, order == "farthest")))


@pytest.fixture
def large(monkeypatch):
    """As if the pyramid did not fit a broadcast."""
    monkeypatch.setattr(pyramid, "fits_broadcast", lambda *a, **k: False)


@pytest.mark.parametrize("order", ["nearest", "farthest"])
@pytest.mark.parametrize("strategy", ["auto", "shuffle"])
@pytest.mark.parametrize("k", [6, 500])
def test_against_brute_force(table, order, strategy, k):
    points = brute.scattered(150, 4) + [(900, None, 1.0)]
    centres = brute.scattered(12, 5) + [(50, 400.0, -300.0), (51, None, 0.0), (52, 0.0, 0.0)]
    got = planar.batch_knn(table(points), table(centres).withColumnRenamed("id", "q"), k, order=order, strategy=strategy)
    assert got.columns == ["q", "id", "x", "y", "distance", "rk"]
    assert answers(got) == expected(points, centres, k, order)


@pytest.mark.parametrize("order", ["nearest", "farthest"])
def test_large_pyramids(table, large, order):
    points, centres = brute.scattered(600, 8), brute.scattered(30, 9) + [(50, -90.0, 3.0)]
    got = planar.batch_knn(table(points), table(centres).withColumnRenamed("id", "q"), 5, order=order)
    assert answers(got) == expected(points, centres, 5, order)


@pytest.mark.parametrize("order", ["nearest", "farthest"])
@pytest.mark.parametrize("hot_share", [0.0, 0.34])
def test_crowded_cells_are_split(table, monkeypatch, order, hot_share):
    """Most points within a thousandth of the extent, and copies of one of them."""
    monkeypatch.setattr(pyramid, "_SPLIT_POINTS", 20)
    monkeypatch.setattr(pyramid, "_SPLIT_TIMES", 1)
    crowd = brute.scattered(2_000, 3, hot_share=hot_share, hot=(0.01, 0.02), span=0.05)
    points = crowd + [(5_000 + i, x, y) for i, x, y in brute.scattered(200, 4, span=1_000.0)]
    centres = [(1, 0.01, 0.02), (2, 0.03, 0.03), (3, 500.0, 500.0), (4, 0.0, 900.0), (5, 0.05, 0.0)]
    got = planar.batch_knn(table(points), table(centres).withColumnRenamed("id", "q"), 7, order=order)
    assert answers(got) == expected(points, centres, 7, order)


POINT = st.tuples(
    st.sampled_from([0.0, 1.0, -1.0, 3.5, 1e-9, 1e9, -7.25]) | st.floats(-50, 50),
    st.sampled_from([0.0, 2.0, -1.0, 1e-9, 1e9]) | st.floats(-50, 50))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(POINT, min_size=1, max_size=40), st.lists(POINT, min_size=1, max_size=6), st.integers(1, 9))
def test_any_points(spark, points, centres, k):
    points = [(i, x, y) for i, (x, y) in enumerate(points)]
    centres = [(i, x, y) for i, (x, y) in enumerate(centres)]
    df = spark.createDataFrame(points, "id BIGINT, x DOUBLE, y DOUBLE")
    asked = spark.createDataFrame(centres, "q BIGINT, x DOUBLE, y DOUBLE")
    for order in ("nearest", "farthest"):
        assert answers(planar.batch_knn(df, asked, k, order=order)) == expected(points, centres, k, order)


@pytest.mark.parametrize("order", ["nearest", "farthest"])
def test_points_at_infinity_and_empty_tables(table, order):
    points = [(1, 0.0, 0.0), (2, 3.0, 4.0), (3, INF, 0.0), (4, 0.0, -INF), (5, None, None)]
    centre = table([(1, 1.0, 0.0)]).withColumnRenamed("id", "q")
    for k in (1, 3, 9):
        assert answers(planar.batch_knn(table(points), centre, k, order=order)) == expected(points, [(1, 1.0, 0.0)], k, order)
    assert planar.batch_knn(table([]), centre, 3, order=order).count() == 0
    assert planar.batch_knn(table(points), centre.where("false"), 3, order=order).count() == 0


def test_scans_do_not_depend_on_size(spark, tmp_path):
    """Every read of a point goes through an accumulator."""
    reads = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(x):
        reads.add(1)
        return x

    scans = {}
    for n in (400, 4_000):
        path = str(tmp_path / f"t{n}")
        spark.createDataFrame(brute.scattered(n, n), "id BIGINT, x DOUBLE, y DOUBLE").write.parquet(path)
        df = spark.read.schema("id BIGINT, x DOUBLE, y DOUBLE").parquet(path).withColumn("x", seen("x"))
        centres = spark.createDataFrame(brute.scattered(20, 2), "q BIGINT, x DOUBLE, y DOUBLE")
        for k in (1, 30):
            for order in ("nearest", "farthest"):
                before = reads.value
                planar.batch_knn(df, centres, k, order=order).collect()
                scans[n, k, order] = (reads.value - before) / n
    assert len(set(scans.values())) == 1 and max(scans.values()) <= 6  # each of 3 scans may test x and use it


def test_candidates_stay_few(table, monkeypatch):
    """The bounds leave a few times k points per centre."""
    met = []
    plain = batch.cell_join

    def counting(*args, **options):
        out = plain(*args, **options)
        met.append(out.count())
        return out

    monkeypatch.setattr(batch, "cell_join", counting)
    points, centres = brute.scattered(8_000, 1), brute.scattered(100, 2)
    for order, most in (("nearest", 8), ("farthest", 40)):
        planar.batch_knn(table(points), table(centres).withColumnRenamed("id", "q"), 10, order=order)
        assert 10 * len(centres) <= met.pop() <= most * 10 * len(centres)


def test_registered_farthest(spark):
    sf = "/root/testdata/sf0.01"
    points = sorted((r.id, r.x, r.y) for r in fixtures.points(spark, sf).collect())
    ids, x, y = (np.array(c) for c in zip(*points))
    got = {}
    for r in entry.queries()["batch_kfar"](spark, sf).collect():
        got.setdefault(r.q, []).append((r.rk, r.id))
    for c in fixtures.centres(spark, sf).collect():
        farthest = np.lexsort((ids, -np.sqrt((x - c.x) ** 2 + (y - c.y) ** 2)))[:10]
        assert [i for _, i in sorted(got[c.q])] == ids[farthest].tolist()


def test_unknown_order(table):
    with pytest.raises(ValueError, match="order"):
        planar.batch_knn(table([]), table([]).withColumnRenamed("id", "q"), 1, order="best")


@pytest.mark.parametrize("nearest", [True, False])
def test_bounds_are_not_worked_out_again_per_cell(table, nearest):
    """The cells come from storage, not from nested expressions on the counts."""
    points = table(brute.scattered(200, 4))
    extent = batch._extent(points)
    counts, _ = pyramid.build(points, extent, 3, lambda p: p)
    queries = table([(1, 500.0, 500.0), (2, 0.0, 0.0)]).selectExpr("id AS q", "x AS _qx", "y AS _qy")
    got = pyramid.best_cells(queries, counts, 3, nearest).select("q", F.inline("_cells"))
    assert sorted({r.q for r in got.collect()}) == [1, 2]
    assert "sort_array" not in got._jdf.queryExecution().optimizedPlan().toString()
