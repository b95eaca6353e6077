"""The queries on snap points, over ids whose third power a BIGINT does not hold."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry

# Snap points repeat every 720 ids, so ids further on by this have the same places.
FAR = 720 * 10_000
NAMES = [
    "batch_box_ranges_parts", "batch_knn_bag", "batch_knn_snap", "box_18x9_snap", "join_0_1_snap",
    "join_bag_shuffle", "join_null_ids_hot", "kfar_100_narrow", "knn_100_snap",
]


def folder(spark, path, first):
    for name, column, kind, ids in (
        ("events", "event_id", "BIGINT", range(first, first + 400)),
        ("supplier", "s_suppkey", "BIGINT", range(first, first + 30)),
        ("nation", "n_nationkey", "INT", range(25)),
    ):
        rows = [(i,) for i in (*ids, *list(ids)[:3])]
        spark.createDataFrame(rows, f"{column} {kind}").write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    return [folder(spark, tmp_path_factory.mktemp("ids"), first) for first in (0, FAR)]


def rows(df):
    """With ids as from 0."""
    return sorted(tuple(v - FAR if isinstance(v, int) and v >= FAR else v for v in r) for r in df.collect())


@pytest.mark.parametrize("name", NAMES)
def test_far_ids_give_the_same_rows(spark, folders, name):
    near, far = (rows(entry.queries()[name](spark, path)) for path in folders)
    assert near and near == far
