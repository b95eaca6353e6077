"""Point tables from ids that a larger copy of the tables has."""

from __future__ import annotations

from planar import fixtures


def remainder(v, m):
    """With the sign of ``v``, as in SQL."""
    return abs(v) % m if v >= 0 else -(abs(v) % m)


def test_snap_points_of_large_and_negative_ids(spark, tmp_path):
    ids = [0, 1, 719, 891_000, 892_000, 6_000_000, 36_000_001, -1, -255, -361, -891_000, None]
    spark.createDataFrame([(i,) for i in ids], "event_id BIGINT").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.id: (r.x, r.y) for r in fixtures.points(spark, str(tmp_path), recipe="snap").collect()}
    for i in ids[:-1]:
        x = remainder(i * i * 31 + i * 7919, 720) / 2 - 180
        y = remainder(i**3 * 13 + i * i * 7 + i * 29, 360) / 2 - 90
        assert got[i] == (x, y)
    assert got[None] == (None, None)
