"""The grid join against brute force, on both strategies."""

from __future__ import annotations

from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import brute
import planar
from planar.plans import skew
from planar.plans.grid import CELL
from planar.plans.sizing import fits_broadcast
from planar.plans.skew import hot_cells, no_more_blocks_than_help

STRATEGIES = [{"strategy": "broadcast"}, {"strategy": "shuffle"}, {"strategy": "shuffle", "block_rows": 7}]


def id_pairs(df) -> Counter:
    return Counter((r.a_id, r.b_id) for r in df.select("a_id", "b_id").collect())


@pytest.mark.parametrize("options", STRATEGIES)
@pytest.mark.parametrize("radius", [0.05, 1.0, 7.5, 100.0])
def test_equals_brute_force(spark, table, options, radius):
    left, right = brute.scattered(150, 1), brute.scattered(60, 2)
    left += [(900, None, 1.0), (901, 1.0, None)]
    got = planar.distance_join(table(left), table(right), radius, **options)
    assert id_pairs(got) == brute.pairs(left, right, radius)


@pytest.mark.parametrize("options", STRATEGIES)
def test_a_third_of_the_rows_in_one_place(spark, table, options):
    left = brute.scattered(300, 3, hot_share=0.34)
    right = brute.scattered(90, 4, hot_share=0.34)
    got = planar.distance_join(table(left), table(right), 1.5, **options)
    assert id_pairs(got) == brute.pairs(left, right, 1.5)


@pytest.mark.parametrize("options", STRATEGIES)
def test_copies_without_an_id_stay(spark, table, options):
    rows = [(1.0, 1.0)] * 40 + [(1.2, 1.0)] * 3 + [(5.0, 5.0)]
    df = spark.createDataFrame(rows, "x DOUBLE, y DOUBLE")
    got = planar.distance_join(df, df, 0.5, **options)
    assert got.columns == ["a_x", "a_y", "b_x", "b_y"]
    want = Counter(a + b for a in rows for b in rows if brute.dist(a, b) < 0.5)
    assert Counter(tuple(r) for r in got.collect()) == want


@pytest.mark.parametrize("options", STRATEGIES)
def test_self_join_keeps_identity_and_both_orders(spark, table, options):
    df = table([(1, 0.0, 0.0), (2, 0.5, 0.0), (3, 9.0, 9.0)])
    got = id_pairs(planar.distance_join(df, df, 1, **options))
    assert got == Counter([(1, 1), (1, 2), (2, 1), (2, 2), (3, 3)])


def test_exact_radius_is_outside(spark, table):
    a, b = table([(1, 0.0, 0.0)]), table([(2, 3.0, 4.0)])
    assert planar.distance_join(a, b, 5).count() == 0
    assert planar.distance_join(a, b, 5.000001).count() == 1
    assert planar.distance_join(a, b, 0).count() == 0


def test_extra_columns_and_distance(spark, table):
    a = table([(1, 0.0, 0.0)]).withColumn("name", F.lit("n"))
    got = planar.distance_join(a, table([(2, 3.0, 4.0)]), 6, prefixes=("l_", "r_"), with_distance=True)
    assert got.columns == ["l_id", "l_x", "l_y", "l_name", "r_id", "r_x", "r_y", "distance"]
    assert got.first().distance == 5.0


def test_side_over_the_limit_is_not_broadcast(spark, table):
    a, b = table(brute.scattered(50, 5)), table(brute.scattered(50, 6))
    got = planar.distance_join(a, b, 2, strategy="broadcast", broadcast_bytes=100)
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert id_pairs(got) == brute.pairs(brute.scattered(50, 5), brute.scattered(50, 6), 2)


coordinate = st.one_of(
    st.integers(-40, 40).map(lambda v: v / 4), st.floats(-200, 200, allow_nan=False), st.sampled_from([0.1, 0.3, 9999.5])
)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.tuples(coordinate, coordinate), min_size=1, max_size=25),
    st.lists(st.tuples(coordinate, coordinate), min_size=1, max_size=25),
    st.sampled_from([1e-9, 0.1, 0.25, 1.0, 3.0, 50.0]),
    st.sampled_from(STRATEGIES),
)
def test_any_points(spark, table, left, right, radius, options):
    left = [(i, *p) for i, p in enumerate(left)]
    right = [(i, *p) for i, p in enumerate(right)]
    got = planar.distance_join(table(left), table(right), radius, **options)
    assert id_pairs(got) == brute.pairs(left, right, radius)


def test_every_hot_cell_is_found(spark):
    """However many there are: 3,000 of them, and one that holds a third of the rows."""
    many = spark.range(90_000).select((F.col("id") % 3_000).alias(CELL))
    one = spark.range(45_000).select(F.lit(-1).cast("bigint").alias(CELL))
    hot = hot_cells(many.unionByName(one), many.where("_cell < 10"), [CELL], 20)
    rows = {r[CELL]: (r._na, r._nb) for r in hot.collect()}
    assert len(rows) == 3_001 and rows[-1] == (2_250, 1) and rows[3] == (2, 2) and rows[2_999] == (2, 1)


@pytest.mark.parametrize("strategy", ["broadcast", "shuffle"])
def test_empty_sides(spark, table, strategy):
    some, none = table([(1, 1.0, 1.0)]), table([])
    for a, b in ((some, none), (none, some), (none, none)):
        assert planar.distance_join(a, b, 5, strategy=strategy).count() == 0
        assert planar.distance_join(a.drop("id"), b.drop("id"), 5, strategy=strategy).count() == 0


def test_broadcast_needs_a_measured_size(spark, table):
    rows = [(i, 1.0, 1.0) for i in range(1_000)]
    assert fits_broadcast(table(rows), 9) and not fits_broadcast(table(rows), 9, limit=100_000)
    in_memory = spark.createDataFrame(rows, "id BIGINT, x DOUBLE, y DOUBLE")  # no estimate
    assert fits_broadcast(in_memory, 9) and not fits_broadcast(in_memory, 9, limit=100_000)
    wide = table(rows).withColumn("text", F.repeat(F.lit("x"), 1_000))
    assert not fits_broadcast(wide, 9, limit=5_000_000)
    nested = table(rows).withColumn("list", F.array("x")).withColumn("p", F.struct("x", "y"))
    assert fits_broadcast(nested) and not fits_broadcast(nested, limit=60_000)


@pytest.mark.parametrize("options", STRATEGIES)
def test_rows_without_an_id_stay_as_they_are(spark, options):
    """Values that are equal without being identical keep their form."""
    df = spark.sql("""
        SELECT 1D AS x, y, t COLLATE UTF8_LCASE AS t, parse_json('{"a": 1}') AS v
        FROM VALUES (0D, 'A'), (-0D, 'a'), (0D, 'a'), (0D, 'a') AS r(y, t)""")
    got = planar.distance_join(df, df.select("x", "y"), 1, **options)
    rows = got.select(F.col("a_y").cast("string"), F.col("a_t").cast("binary").cast("string"), F.to_json("a_v")).collect()
    want = Counter({("0.0", "A", '{"a":1}'): 4, ("-0.0", "a", '{"a":1}'): 4, ("0.0", "a", '{"a":1}'): 8})
    assert Counter(tuple(r) for r in rows) == want


@pytest.mark.parametrize("options", STRATEGIES)
def test_large_and_infinite_coordinates(spark, table, options):
    inf = float("inf")
    left = [(1, 1e15, 0.0), (2, inf, 0.0), (3, 2e9, 2e9), (4, -inf, inf), (5, 1e300, -1e300)]
    right = [(1, 1e15 + 0.25, 0.0), (2, inf, 0.0), (3, 2e9 + 0.05, 2e9), (4, 1e15 + 1, 0.0), (5, 1e300, -1e300)]
    assert id_pairs(planar.distance_join(table(left), table(right), 0.5, **options)) == Counter([(1, 1), (3, 3), (5, 5)])
    with pytest.raises(ValueError):
        planar.distance_join(table(left), table(right), inf)


def test_calm_join_without_id_shuffles_once(spark, table):
    df = table(brute.scattered(60, 8)).drop("id")
    plan = planar.distance_join(df, df, 1, strategy="shuffle")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_blocks_of_many_hot_cells_stay_few(spark):
    """Small blocks of large cells would copy each row to hundreds of them."""
    cells = spark.range(200_000).select((F.col("id") % 20).alias(CELL))
    hot = hot_cells(cells, cells, [CELL], 2)
    assert {(r._na, r._nb) for r in hot.collect()} == {(5_000, 5_000)}
    fewer = no_more_blocks_than_help(hot).collect()
    assert len(fewer) == 20 and 2_000 < sum(r._na * r._nb for r in fewer) < 8_192
    some = hot_cells(cells, cells, [CELL], 1_000)
    assert {(r._na, r._nb) for r in no_more_blocks_than_help(some).collect()} == {(10, 10)}


def test_a_hot_join_shuffles_no_copies_by_the_hundred(spark, table, monkeypatch):
    """The rows of both sides after they were dealt to blocks."""
    dealt = []
    plain = skew._to_blocks

    def counting(df, *args):
        out = plain(df, *args)
        dealt.append((df.count(), out.count()))
        return out

    monkeypatch.setattr(skew, "_to_blocks", counting)
    left, right = ([(i, 0.1 * (i % 3), 0.0) for i in range(n)] for n in (2_000, 1_000))
    got = planar.distance_join(table(left), table(right), 0.05, strategy="shuffle", block_rows=2)
    assert got.count() == sum(1 for a in left for b in right if a[1] == b[1])
    assert len(dealt) == 2 and all(after < 100 * before for before, after in dealt)
