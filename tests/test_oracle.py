"""Every registered query against its SQL text in DuckDB."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
import oracle

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = entry.core_queries(), entry.core_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


def test_every_query_has_sql():
    assert QUERIES.keys() == SQL.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    ok, message = oracle.same(QUERIES[name](spark, SF_DIR), con, SQL[name])
    assert ok, message


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["a_id", "a_x", "a_y", "b_id", "b_x", "b_y"]
    assert df.count() == 48


@pytest.mark.parametrize(
    "name, rows",
    [("box_fixed", 2493), ("box_18x9", 30), ("box_18x9_snap", 14), ("circle_10", 67), ("circle_50_fixed", 449),
     ("join_0_1_snap", 3244), ("join_10", 4826), ("batch_box", 617)],
)
def test_known_counts(spark, name, rows):
    assert QUERIES[name](spark, "/root/testdata/sf0.01").count() == rows
