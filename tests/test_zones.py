"""Zone tables, summed counts, and ranges of the Z-order curve."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import brute
import planar
from planar.operators import summed, zranges
from planar.sources import zones

INF = float("inf")
BOXES = "q BIGINT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE"


def hits(points, boxes):
    out = Counter()
    for q, x0, y0, x1, y1 in boxes:
        if None in (x0, y0, x1, y1):
            continue
        (x0, x1), (y0, y1) = sorted((x0, x1)), sorted((y0, y1))
        for i, x, y in points:
            if x is not None and y is not None and x0 < x < x1 and y0 < y < y1:
                out[q, i] += 1
    return out


# --- zones ---------------------------------------------------------------------


@pytest.mark.parametrize("tile", [None, 8.0])
@pytest.mark.parametrize("order", ["nearest", "farthest"])
def test_knn_reads_few_files(spark, table, tmp_path, order, tile):
    rows = brute.scattered(4_000, 3) + [(9_000, None, 1.0), (9_001, 2.0, None)]
    path = str(tmp_path / "landed")
    planar.land_points(table(rows), path, files=40, tile=tile)
    every = planar.write_zones(spark, path, tile=tile)
    assert every.agg(F.sum("n")).first()[0] == 4_000
    for cx, cy, k in ((3.0, 4.0, 10), (-50.0, 90.0, 3), (10.0, 10.0, 5_000)):
        got = planar.knn_landed(spark, path, cx, cy, k, order, tile=tile)
        want = [(i, d) for d, i in brute.nearest(rows, (cx, cy), k, order == "farthest")]
        assert [(r.id, r.distance) for r in got.collect()] == want
        if k < 100:
            assert len(got.inputFiles()) < every.count() / 3


def test_zones_of_infinite_and_missing_points(spark, table, tmp_path):
    path = str(tmp_path / "landed")
    rows = [(1, 0.0, 0.0), (2, INF, 0.0), (3, None, None), (4, 5.0, 5.0)]
    planar.land_points(table(rows), path, files=4)
    planar.write_zones(spark, path)
    for k, order in ((1, "nearest"), (3, "nearest"), (1, "farthest"), (2, "farthest")):
        got = [r.id for r in planar.knn_landed(spark, path, 0, 0, k, order).collect()]
        assert got == [i for _, i in brute.nearest(rows, (0.0, 0.0), k, order == "farthest")]
    empty = str(tmp_path / "empty")
    planar.land_points(table([]), empty)
    planar.write_zones(spark, empty)
    assert planar.knn_landed(spark, empty, 0, 0, 3).count() == 0


def test_many_files_mean_the_whole_table(spark, table, tmp_path, monkeypatch):
    monkeypatch.setattr(zones, "MOST_FILES", 1)
    rows, path = brute.scattered(500, 1), str(tmp_path / "landed")
    planar.land_points(table(rows), path, files=8)
    planar.write_zones(spark, path)
    got = [r.id for r in planar.knn_landed(spark, path, 10, 10, 200).collect()]
    assert got == [i for _, i in brute.nearest(rows, (10.0, 10.0), 200)]


# --- boxes ---------------------------------------------------------------------

SOME = [
    (1, 0.0, 0.0, 20.0, 20.0), (2, 5.0, 5.0, 5.5, 5.25), (3, -100.0, -100.0, 100.0, 100.0), (4, 20.0, 20.0, 0.0, 0.0),
    (5, 10.0, 20.0, 10.0, 30.0), (6, None, 0.0, 1.0, 1.0), (7, 300.0, 300.0, 400.0, 400.0), (8, 9.0, 19.0, 11.0, 21.0),
    (9, -INF, -INF, INF, INF), (10, 19.0, -5.0, 25.0, 3.0), (11, 4.0, 4.0, 16.0, 12.0),
]


@pytest.mark.parametrize("options", [{}, {"cells": 7}, {"cells": 1}, {"strategy": "shuffle", "block_rows": 30}])
def test_summed_counts(spark, table, options):
    points = brute.scattered(900, 6, hot_share=0.3) + [(5_000, None, 1.0), (5_001, INF, 3.0), (5_002, 4.0, 4.0), (5_003, 16.0, 12.0)]
    boxes = spark.createDataFrame(SOME, BOXES)
    got = {r.q: r.n for r in planar.batch_box_count_summed(table(points), boxes, **options).collect()}
    want = Counter(q for q, _ in hits(points, SOME).elements())
    assert got == {b[0]: want[b[0]] for b in SOME}


def test_summed_counts_of_little(spark, table):
    boxes = spark.createDataFrame(SOME, BOXES)
    assert {r.n for r in planar.batch_box_count_summed(table([]), boxes).collect()} == {0}
    one = planar.batch_box_count_summed(table([(1, 4.5, 5.0)] * 3), boxes)
    assert {r.q: r.n for r in one.collect() if r.n} == {1: 3, 3: 3, 4: 3, 9: 3, 11: 3}
    assert planar.batch_box_count_summed(table([(1, 1.0, 1.0)]), boxes.where("false")).count() == 0


def test_points_compared_grow_with_the_edge(spark, table, monkeypatch):
    """Boxes twice as wide have four times the points, but compare twice as many."""
    compared = []
    plain = summed.cell_join

    def counting(big, small, residual, **options):
        compared.append(plain(big, small, F.lit(True), **options).count())
        return plain(big, small, residual, **options)

    monkeypatch.setattr(summed, "cell_join", counting)
    points = table([(i, (i * 7919 % 20011) / 100, (i * 104729 % 20021) / 100) for i in range(20_000)])
    for half in (20.0, 40.0, 80.0):
        boxes = spark.createDataFrame([(1, 100 - half, 100 - half, 100 + half, 100 + half)], BOXES)
        inside = planar.batch_box_count_summed(points, boxes, cells=128).first().n
        assert compared[-1] < inside
    assert 1.5 < compared[1] / compared[0] < 2.6 and 1.5 < compared[2] / compared[1] < 2.6


@pytest.mark.parametrize("options", [{}, {"part_rows": 40}, {"part_rows": 7, "cells": 1}, {"part_rows": 100, "cells": 16}])
def test_ranges(spark, table, options):
    points = brute.scattered(900, 6, hot_share=0.3) + [(5_000, None, 1.0), (5_001, INF, 3.0), (5_002, 4.0, 4.0), (5_003, 16.0, 12.0)]
    got = planar.batch_box_ranges(table(points), spark.createDataFrame(SOME, BOXES), **options)
    assert got.columns == ["q", "id", "x", "y"]
    assert Counter((r.q, r.id) for r in got.collect()) == hits(points, SOME)


def test_ranges_of_little(spark, table):
    boxes = spark.createDataFrame(SOME, BOXES)
    assert planar.batch_box_ranges(table([]), boxes).count() == 0
    assert planar.batch_box_ranges(table([(1, 1.0, 1.0)]), boxes.where("false")).count() == 0
    same = [(i, 4.5, 5.0) for i in range(50)]
    got = planar.batch_box_ranges(table(same).drop("id"), boxes, part_rows=4)
    assert Counter(r.q for r in got.collect()) == Counter(q for q, _ in hits(same, SOME))


def test_every_point_is_shuffled_once(spark, table, tmp_path):
    """Boxes of all sizes, and the points are one row each before the merge."""
    points = table(brute.scattered(3_000, 2, hot_share=0.3))
    boxes = spark.createDataFrame([(i, 0.0, 0.0, 20.0 / 2**i, 20.0 / 2**i) for i in range(9)], BOXES)
    root = planar.batch_box_ranges(points, boxes, part_rows=200)._jdf.queryExecution()
    text = root.executedPlan().toString()
    assert text.count("Exchange") == 1 and "Generate" not in text and "Join" not in text


def test_parts_are_even(spark, table):
    z = F.col("id")
    hot = spark.range(10_000).select(F.when(F.col("id") % 3 == 0, 77).otherwise(F.col("id")).alias("id"))
    begin, blocks = zranges._cuts(hot, z, 10_000, 500)
    part = np.searchsorted(begin, [r.id for r in hot.collect()], "right")
    assert (np.bincount(part, minlength=len(blocks)) / blocks).max() < 1_200
    assert blocks.sum() == 20


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=4, max_size=4), st.integers(1, 6))
def test_ranges_cover_a_box(ends, cells):
    (i0, i1), (j0, j1) = sorted(ends[:2]), sorted(ends[2:])
    first, last = zranges.ranges_of(i0, i1, j0, j1, cells)
    assert len(first) <= (cells + 1) ** 2 and (first <= last).all() and (first[1:] > last[:-1] + 1).all()
    i, j = (v.ravel() for v in np.meshgrid(np.arange(i0, i1 + 1), np.arange(j0, j1 + 1)))
    z = zranges._interleaved(i) | zranges._interleaved(j) << 1
    at = np.searchsorted(first, z, "right") - 1
    assert (at >= 0).all() and (z <= last[at]).all()
