"""Batches: the same rows as the single queries."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import brute
import planar
from planar import fixtures

STRATEGIES = [{"strategy": "auto"}, {"strategy": "shuffle"}, {"strategy": "shuffle", "block_rows": 9}]


BOXES = [
    (1, 2.0, 2.0, 5.0, 9.0), (2, 5.0, 9.0, 2.0, 2.0), (3, -1e4, -1e4, 1e4, 1e4), (4, 3.0, 3.0, 3.0, 8.0),
    (5, 10.0, 20.0, 10.5, 20.5), (6, 9.9, 19.9, 10.1, 20.1), (7, None, 0.0, 1.0, 1.0), (8, 500.0, 500.0, 501.0, 501.0),
    (9, float("-inf"), 0.0, float("inf"), 4.0), (10, 0.0, 0.0, 1e-6, 1e-6),
]


def in_box(p, box):
    if None in p or None in box:
        return False
    x0, x1 = sorted((box[1], box[3]))
    y0, y1 = sorted((box[2], box[4]))
    return x0 < p[1] < x1 and y0 < p[2] < y1


@pytest.mark.parametrize("options", STRATEGIES)
def test_boxes_of_all_sizes(spark, table, options):
    points = brute.scattered(200, 1, hot_share=0.34) + [(900, None, 3.0), (901, 5.0, 2.0)]
    boxes = table(BOXES, "q BIGINT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE")
    got = planar.batch_box(table(points), boxes, **options)
    assert got.columns == ["q", "id", "x", "y"]
    want = sorted((b[0], p[0]) for b in BOXES for p in points if in_box(p, b))
    assert sorted((r.q, r.id) for r in got.collect()) == want
    counts = planar.batch_box_count(table(points), boxes, **options)
    want_n = {b[0]: sum(in_box(p, b) for p in points) for b in BOXES}
    assert {r.q: r.n for r in counts.collect()} == want_n


@pytest.mark.parametrize("options", STRATEGIES)
def test_boxes_on_copies_without_id(spark, table, options):
    points = table([(1.0, 1.0)] * 30 + [(2.0, 2.0)], "x DOUBLE, y DOUBLE")
    boxes = table([(1, 0.0, 0.0, 1.5, 1.5), (2, 0.0, 0.0, 3.0, 3.0)],
                  "q BIGINT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE")
    got = planar.batch_box(points, boxes, **options).groupBy("q").count().collect()
    assert {r.q: r["count"] for r in got} == {1: 30, 2: 31}


def test_no_boxes(spark, table):
    boxes = table([], "q BIGINT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE")
    assert planar.batch_box(table(brute.scattered(5, 1)), boxes).count() == 0


@pytest.mark.parametrize("options", STRATEGIES)
def test_circles(spark, table, options):
    points, centres = brute.scattered(120, 2), brute.scattered(20, 3)
    got = planar.batch_circle(table(points), table(centres).withColumnRenamed("id", "q"), 2.5, **options)
    assert got.columns == ["q", "id", "x", "y", "distance"]
    want = sorted((q, i) for (i, q) in brute.pairs(points, centres, 2.5).elements())
    assert sorted((r.q, r.id) for r in got.collect()) == want


KNN = [{}, {"strategy": "shuffle"}, {"strategy": "shuffle", "block_rows": 9}]


@pytest.mark.parametrize("options", KNN)
@pytest.mark.parametrize("k", [1, 5, 500])
def test_knn_join(spark, table, options, k):
    points = brute.scattered(150, 4) + [(900, None, 1.0)]
    centres = brute.scattered(12, 5) + [(50, 400.0, -300.0), (51, None, 0.0)]
    got = planar.batch_knn(table(points), table(centres).withColumnRenamed("id", "q"), k, **options)
    assert got.columns == ["q", "id", "x", "y", "distance", "rk"]
    have = sorted((r.q, r.rk, r.distance, r.id) for r in got.collect())
    want = sorted(
        (c[0], i + 1, d, pid)
        for c in centres if None not in c
        for i, (d, pid) in enumerate(brute.nearest(points, c[1:], k))
    )
    assert have == want


@pytest.mark.parametrize("options", [{}, {"strategy": "shuffle", "block_rows": 500}])
def test_knn_join_with_a_hot_point(spark, table, options):
    """A third of all points are copies of one, enough to be cut to k beforehand."""
    points = brute.scattered(6_000, 6, hot_share=0.34)
    df = table(points)
    centres = [(1, 10.0, 20.0), (2, 10.1, 19.9), (3, 0.0, 0.0), (4, 10.0, 19.0)]
    got = planar.batch_knn(df, table(centres).withColumnRenamed("id", "q"), 7, **options)
    have = sorted((r.q, r.rk, r.distance, r.id) for r in got.collect())
    want = sorted(
        (c[0], i + 1, d, pid) for c in centres for i, (d, pid) in enumerate(brute.nearest(points, c[1:], 7))
    )
    assert have == want


def test_workload_is_repeatable_and_in_range(spark, table):
    ids = spark.range(2_000).withColumnRenamed("id", "q")
    once = planar.workload(ids, seed=3, size=0.1)
    assert sorted(once.collect()) == sorted(planar.workload(ids.repartition(5), seed=3, size=0.1).collect())
    assert once.collect() != planar.workload(ids, seed=4, size=0.1).collect()
    r = once.agg(
        F.min("x1"), F.max("x1"), F.avg("x1"), F.min("cx"), F.max("cx"), F.avg("cx"), F.max(F.abs("cy")),
        F.max(F.abs(F.col("x1") - F.col("x0") - 18)), F.max(F.abs(F.col("y1") - F.col("y0") - 9)), F.corr("x1", "y1"),
    ).first()
    assert 0 <= r[0] < 2 and 178 < r[1] < 180 and 85 < r[2] < 95
    assert -180 < r[3] < -160 and 160 < r[4] < 180 and -8 < r[5] < 8 and 70 < r[6] < 90
    assert r[7] < 1e-9 and r[8] < 1e-9 and abs(r[9]) < 0.1


@pytest.mark.parametrize("options, scale", [(STRATEGIES[0], 2e9), (STRATEGIES[1], 1e15), (STRATEGIES[0], 1e300)])
def test_single_and_batch_agree_far_out(spark, table, options, scale):
    points = [(i, x * scale, y * scale) for i, (x, y) in enumerate([(0, 0), (1, 0), (1, 1), (-1, 0.5), (0.5, -1), (1e-7, 0)])]
    points += [(90, float("inf"), 0.0), (91, 0.0, float("-inf"))]
    df = table(points)
    for half in (0.75 * scale, float("inf")):
        boxes = spark.createDataFrame([(1, -half, -half, half, half)], "q BIGINT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE")
        got = sorted(r.id for r in planar.batch_box(df, boxes, **options).collect())
        assert got == sorted(r.id for r in planar.box_query(df, -half, -half, half, half).collect())
    if scale < 1e100:  # squares stay finite
        for k, cx in ((3, 0.2 * scale), (20, 50 * scale)):
            centre = spark.createDataFrame([(1, cx, 0.0)], "q BIGINT, x DOUBLE, y DOUBLE")
            got = [(r.id, r.distance) for r in planar.batch_knn(df, centre, k, **options).orderBy("rk").collect()]
            assert got == [(r.id, r.distance) for r in planar.knn(df, cx, 0.0, k).collect()]


def test_knn_without_an_id(spark, table):
    rows = brute.scattered(400, 7, hot_share=0.3)
    df, centres = table(rows).drop("id"), table(brute.scattered(20, 9)).withColumnRenamed("id", "q")
    got = planar.batch_knn(df, centres, 8, strategy="shuffle")
    assert got.columns == ["q", "x", "y", "distance", "rk"]
    want = planar.batch_knn(table(rows), centres, 8)
    key = lambda d: sorted((r.q, r.rk, r.distance) for r in d.collect())
    assert key(got) == key(want)


def test_more_than_a_thousand_neighbours(spark, table):
    rows = brute.scattered(3_000, 11, hot_share=0.34)
    centres = [(1, 0.0, 0.0), (2, 10.0, 20.0)]
    got = planar.batch_knn(table(rows), table(centres).withColumnRenamed("id", "q"), 1_001)
    for c in centres:
        want = [pid for _, pid in brute.nearest(rows, c[1:], 1_001)]
        assert [r.id for r in got.where(f"q = {c[0]}").orderBy("rk").collect()] == want


def test_remote_centres_meet_few_points(spark, table):
    """Far outside the data only its near edge is looked at."""
    from planar.plans import skew

    rows = [(i, (i * 7919 % 1000) / 1000, (i * 104729 % 997) / 997) for i in range(4_000)]
    centres = [(i, 1000.0 * [1, 0, -1, 0.7][i % 4], 1000.0 * [0.1, 1, 0.5, 0.7][i % 4]) for i in range(40)]
    met = []
    plain = skew.cell_join

    def counting(big, small, residual, **options):
        met.append(plain(big, small, F.lit(True), **options).count())
        return plain(big, small, residual, **options)

    from planar.operators import batch

    before, batch.cell_join = batch.cell_join, counting
    try:
        got = planar.batch_knn(table(rows), table(centres).withColumnRenamed("id", "q"), 10).collect()
    finally:
        batch.cell_join = before
    assert met[-1] < 0.05 * len(rows) * len(centres)
    for q, cx, cy in centres[:4]:
        assert [r.id for r in sorted(got, key=lambda r: r.rk) if r.q == q] == [i for _, i in brute.nearest(rows, (cx, cy), 10)]


def test_clashing_column_is_named(spark, table):
    with pytest.raises(ValueError, match="column q"):
        planar.batch_box(table([(1, 1.0, 1.0)]).withColumn("q", F.lit(1)), table([]))


def test_registered_knn_1001_asks_every_centre(spark):
    """Against brute force over all points, for all centres."""
    sf = "/root/testdata/sf0.01"
    points = sorted((r.id, r.x, r.y) for r in fixtures.points(spark, sf).collect() if r.x is not None and r.y is not None)
    ids, x, y = (np.array(c) for c in zip(*points))
    centres = fixtures.centres(spark, sf).collect()
    got = {}
    for r in entry.queries()["batch_knn_1001"](spark, sf).collect():
        got.setdefault(r.q, []).append((r.rk, r.id))
    assert len(got) == len(centres) == 100
    for c in centres:
        nearest = np.lexsort((ids, np.sqrt((x - c.x) ** 2 + (y - c.y) ** 2)))[:1_001]
        assert [i for _, i in sorted(got[c.q])] == ids[nearest].tolist()


def test_counts_of_many_points_by_sums(table, monkeypatch):
    """The same counts; the hits are not made one by one."""
    points = table(brute.scattered(300, 1, hot_share=0.34) + [(900, None, 3.0), (901, 5.0, 2.0), (902, float("inf"), 1.0)])
    nan = float("nan")
    boxes = table([*BOXES, (70, nan, 0.0, -50.0, 500.0), (71, -1e300, -1e300, 1e300, 1e300), (72, 0.0, 0.0, 0.0, 5.0), (1, 0.0, 0.0, 9.0, 9.0)],
                  "q BIGINT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE")
    want = sorted((r.q, r.n) for r in planar.batch_box_count(points, boxes, summed_rows=1 << 40).collect())
    assert sorted((r.q, r.n) for r in planar.batch_box_count(points, boxes, summed_rows=0).collect()) == want
    many = boxes.where("q <> 70")
    monkeypatch.setattr("planar.operators.batch.batch_box", None)
    assert planar.batch_box_count(points, many, summed_rows=0).count() == many.count()
    far = table([(1, 1e15, 1.0), (2, 1e15 + 1, 2.0)])
    with pytest.raises(TypeError):
        planar.batch_box_count(far, many, summed_rows=0)
