"""Pairs of one place come together, so that they are written in few bytes."""

from __future__ import annotations

from itertools import groupby

import pytest

import brute
import planar

SCATTERED = [(i * 7919 % 2_003, float(i * 31 % 40), float(i * 17 % 30)) for i in range(2_003)]



@pytest.mark.parametrize("strategy", ["broadcast", "shuffle"])
def test_pairs_come_by_place(table, strategy):
    left, right = table(SCATTERED), table(SCATTERED[:300])
    got = planar.distance_join(left, right, 3.0, strategy=strategy)
    assert got.count() == sum(brute.pairs(SCATTERED, SCATTERED[:300], 3.0).values())
    places = len({p[1:] for p in SCATTERED})
    assert len([*groupby((r.a_x, r.a_y) for r in got.collect())]) < 2 * places


def test_a_crowded_self_join_keeps_the_rows_of_a_point_together(table):
    df = table(SCATTERED[:1_000])
    for strategy in ("auto", "shuffle"):
        got = planar.distance_join(df, df, 8.0, strategy=strategy, prefixes=("a_", "b_"))
        found = [(r.a_id, r.b_id) for r in got.collect()]
        assert sorted(found) == sorted(brute.pairs(SCATTERED[:1_000], SCATTERED[:1_000], 8.0).elements())
        turns = sum(1 for p, n in zip(found, found[1:]) if p[0] != n[0] and p[1] != n[1])
        assert turns < 0.1 * len(found)


def test_a_hot_place_without_ids_is_in_several_tasks(spark, table):
    from planar.plans.skew import spread_by_place

    hot = spread_by_place(table([(None, 1.0, 1.0)] * 5_000), "x", "y")
    sizes = hot.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == 5_000 and max(sizes) < 2_500


def test_joins_in_text_use_all_cores(spark):
    import __spark_entry__ as entry

    for name in ("sql_join", "sql_raw_join"):
        df = entry.queries()[name](spark, "/root/testdata/sf0.01")
        parts = df.rdd.getNumPartitions()
        assert parts >= spark.sparkContext.defaultParallelism, name


def test_pairs_of_a_large_scan_come_by_place(spark, table, tmp_path):
    """Of a scan in many tasks, the rows that meet none are not shuffled."""
    left = SCATTERED + [(10_000 + i, 5_000.0 + i, 5_000.0) for i in range(500)]
    a, b = table(left), table(SCATTERED[:300])
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        for strategy in ("auto", "broadcast"):
            got = planar.distance_join(a, b, 3.0, strategy=strategy)
            rows = got.collect()
            plan = got._jdf.queryExecution().optimizedPlan().toString()
            assert "LeftSemi" in plan and "RepartitionByExpression" in plan
            found = sorted((r.a_id, r.b_id) for r in rows)
            assert found == sorted(brute.pairs(left, SCATTERED[:300], 3.0).elements())
            places = len({p[1:] for p in SCATTERED})
            assert len([*groupby((r.a_x, r.a_y) for r in rows)]) < 2 * places
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def crowded_table(table, cores, offset):
    """A place per cell of some hundred points, together little to shuffle."""
    many = int((44_000 * cores) ** 0.5)
    return table([(c * many + i, 10.0 * c + offset, offset) for c in range(100) for i in range(many)])


def test_a_join_of_many_pairs_gets_tasks_for_them(spark, table):
    """However few its bytes are."""
    cores = spark.sparkContext.defaultParallelism
    left, right = (crowded_table(table, cores, offset) for offset in (0.1, 0.9))
    for radius, pairs in ((1.0, 0), (1.2, left.count() * right.count() // 100)):
        got = planar.distance_join(left, right, radius, strategy="shuffle")
        assert got.rdd.getNumPartitions() >= 4 * cores
        assert got.count() == pairs


def test_a_join_of_few_pairs_keeps_spark_s_tasks(spark, table):
    left, right = table(SCATTERED), table(SCATTERED[:300])
    got = planar.distance_join(left, right, 3.0, strategy="shuffle")
    assert got.rdd.getNumPartitions() < 4 * spark.sparkContext.defaultParallelism
    assert got.count() == sum(brute.pairs(SCATTERED, SCATTERED[:300], 3.0).values())


def test_hot_cells_of_a_bucketed_join_get_tasks_and_come_by_place(spark, table, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    left, right = (crowded_table(table, cores, offset) for offset in (0.1, 0.9))
    a, b = (planar.land_bucketed(t, f"pairs_{n}", 2.0, buckets=2, path=str(tmp_path / f"pairs_{n}"))
            for n, t in (("a", left), ("b", right)))
    got = planar.bucketed_join(a, b, 1.0, block_rows=300)
    assert got.rdd.getNumPartitions() >= 4 * cores
    assert got.count() == 0
    a, b = (planar.land_bucketed(table(rows), f"place_{n}", 16.0, buckets=2, path=str(tmp_path / f"place_{n}"))
            for n, rows in (("a", SCATTERED), ("b", SCATTERED[:300])))
    got = planar.bucketed_join(a, b, 3.0, block_rows=100)
    rows = got.collect()
    assert sorted((r.a_id, r.b_id) for r in rows) == sorted(brute.pairs(SCATTERED, SCATTERED[:300], 3.0).elements())
    turns = sum(1 for p, n in zip(rows, rows[1:]) if (p.a_x, p.a_y) > (n.a_x, n.a_y))
    assert turns < 0.1 * len(rows)
