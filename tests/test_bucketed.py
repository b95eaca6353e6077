"""Joins of bucketed tables, self joins, and pruning by occupied cells."""

from __future__ import annotations

import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

import brute
import planar
from planar.operators import join
from planar.plans import skew
from planar.plans.grid import CELL, with_cell, with_neighbour_cells


def id_pairs(df) -> Counter:
    return Counter((r.a_id, r.b_id) for r in df.select("a_id", "b_id").collect())


@pytest.fixture
def bucketed(spark, tmp_path):
    tables = []

    def make(rows, width=4.0, buckets=4):
        tables.append(f"t{uuid.uuid4().hex}")
        df = spark.createDataFrame(rows, "id BIGINT, x DOUBLE, y DOUBLE")
        return planar.land_bucketed(df, tables[-1], width, buckets=buckets, path=str(tmp_path / tables[-1]))

    yield make
    for name in tables:
        spark.sql(f"DROP TABLE {name}")


@pytest.mark.parametrize("radius", [0.05, 1.0, 4.0])
@pytest.mark.parametrize("options", [{}, {"block_rows": 5}])
def test_bucketed_join(bucketed, radius, options):
    left = brute.scattered(200, 1, hot_share=0.3) + [(900, None, 1.0), (901, 8.0, 8.0), (902, float("inf"), 0.0)]
    right = brute.scattered(80, 2, hot_share=0.3) + [(900, None, None), (901, 4.0, 8.0), (903, -4.0, -1e-9)]
    got = planar.bucketed_join(bucketed(left), bucketed(right), radius, **options)
    assert got.columns == ["a_id", "a_x", "a_y", "b_id", "b_x", "b_y"]
    assert id_pairs(got) == brute.pairs(left, right, radius)


def test_bucketed_join_of_empty_tables(bucketed):
    some = bucketed([(1, 0.0, 0.0)])
    assert planar.bucketed_join(some, bucketed([]), 1.0).count() == 0
    assert planar.bucketed_join(bucketed([]), some, 1.0).count() == 0
    assert planar.bucketed_join(some, some, 0.0).count() == 0


def test_bucketed_tables_must_agree(bucketed):
    with pytest.raises(ValueError, match="exceeds"):
        planar.bucketed_join(bucketed([(1, 0.0, 0.0)]), bucketed([(2, 0.0, 0.0)]), 5.0)
    with pytest.raises(ValueError, match="different widths"):
        planar.bucketed_join(bucketed([(1, 0.0, 0.0)]), bucketed([(2, 0.0, 0.0)], width=8.0), 1.0)


def exchanges_above(node, table: str, found: list) -> bool:
    """Whether ``node`` reads ``table``; collects the exchanges on the way there."""
    name = node.nodeName()
    children = [node.children().apply(i) for i in range(node.children().size())]
    if name == "AdaptiveSparkPlan":
        children = [node.initialPlan()]
    here = table in node.simpleString(10_000) if "Scan" in name else False
    below = [exchanges_above(c, table, found) for c in children]
    if any(below) and name == "Exchange":
        found.append(name)
    return here or any(below)


def test_no_exchange_on_the_large_side(bucketed):
    left, right = bucketed(brute.scattered(300, 1)), bucketed(brute.scattered(100, 2))
    got = planar.bucketed_join(left, right, 1.0)
    root = got._jdf.queryExecution().executedPlan()
    names = [t.inputFiles()[0].rsplit("/", 2)[1] for t in (left, right)]
    for name, most in zip(names, (0, 1)):  # of the other side, the copies at the edges
        found: list = []
        assert exchanges_above(root, name, found) and len(found) == most
    assert "SortMergeJoin" in root.toString()


def test_a_self_join_compares_half(spark, table, monkeypatch):
    compared = {}
    for name, module in (("self", join), ):
        plain = module.cell_join

        def counting(big, small, residual, **options):
            compared[len(compared)] = plain(big, small, F.lit(True), **options).count()
            return plain(big, small, residual, **options)

        monkeypatch.setattr(module, "cell_join", counting)
    rows = brute.scattered(1_500, 5)
    df = table(rows)
    for options in ({}, {"strategy": "shuffle"}, {"strategy": "shuffle", "block_rows": 40}):
        compared.clear()
        assert id_pairs(planar.distance_join(df, df, 1.0, **options)) == brute.pairs(rows, rows, 1.0)
        assert id_pairs(planar.distance_join(df, df.select("*"), 1.0, **options)) == brute.pairs(rows, rows, 1.0)
        assert compared[0] < 0.62 * compared[1]


@pytest.mark.parametrize("strategy", ["auto", "shuffle"])
def test_a_self_join_without_usable_ids(spark, strategy):
    rows = [(None, 1.0, 1.0)] * 5 + [(7, 1.0, 1.0)] * 3 + [(7, 1.2, 1.0), (None, 5.0, 5.0), (8, None, 2.0)]
    df = spark.createDataFrame(rows, "id BIGINT, x DOUBLE, y DOUBLE").repartition(3)
    got = Counter(tuple(r) for r in planar.self_join(df, 0.5, strategy=strategy, with_distance=True).collect())
    known = [r for r in rows if r[1] is not None]
    want = Counter(a + b + (brute.dist(a[1:], b[1:]),) for a in known for b in known if brute.dist(a[1:], b[1:]) < 0.5)
    assert got == want


def test_rows_that_meet_nothing_are_dropped_before_the_shuffle(table):
    wide = table([(i, float(i % 200), float(i // 200)) for i in range(20_000)])
    few = table([(1, 10.5, 20.5), (2, 150.5, 70.5), (3, -3.0, -3.0)])
    cells, copies = with_cell(wide, "x", "y", 1.0), with_neighbour_cells(few, "x", "y", 1.0)
    kept = join._met(cells, copies)
    asked = {r[0] for r in copies.select(CELL).collect()}
    assert {r[0] for r in kept.select(CELL).collect()} == asked & {r[0] for r in cells.select(CELL).collect()}
    assert kept.count() == 18
    assert join._met(cells, copies, limit=1).count() == 20_000
    plan = planar.distance_join(wide, few, 0.9, strategy="shuffle")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan


def test_blocks_of_rows_without_an_id(spark, table, monkeypatch):
    """A third of the rows in one place and without an id, or with one and the same."""
    for ids in (lambda i: None, lambda i: 5):
        rows = [(ids(i) if i % 3 == 0 else i, 1.0 if i % 3 == 0 else float(i), 1.0) for i in range(3_000)]
        sizes = {}
        plain = skew._to_blocks

        def watched(df, hot, keys, block, rows_first):
            out = plain(df, hot, keys, block, rows_first)
            sizes[block] = max(r[0] for r in out.groupBy(*keys, block).count().select("count").collect())
            return out

        monkeypatch.setattr(skew, "_to_blocks", watched)
        right = table([(1, 1.0, 1.0), (2, 50.0, 1.0)])
        got = planar.distance_join(table(rows), right, 0.5, strategy="shuffle", block_rows=100)
        assert got.count() == 1_002
        assert sizes["_block"] < 200
        monkeypatch.undo()


def test_a_shuffled_input_is_written_before_it_is_numbered(spark):
    df = spark.range(100).repartition(4)
    assert "Exchange" not in skew.scanned(df)._jdf.queryExecution().executedPlan().toString()
    plain = skew.scanned(df)
    assert skew.scanned(plain) is plain
