"""
the SQL text that computes the same rows on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import planar
from planar import fixtures
from planar.plans.scratch import scratch_path
from planar.plans.ship import ship_code
from planar.plans.skew import spread_by_place

try:  # the corpus operators are optional, and so are the packages that they need
    import corpus_pipeline
    from planar.llm import queries as corpus
except ImportError:
    corpus_pipeline = corpus = None

Query = Callable[[SparkSession, str], DataFrame]

# The query parameters that the results are compared for.
BOXES = {
    "box_180x90": (-90, -45, 90, 45),
    "box_18x9": (0, 0, 18, 9),
    "box_1620x810": (-1440, -720, 180, 90),
    "box_fixed": (-180, 0, 0, 136),
}
CIRCLES = {
    "circle_10": (0, 0, 10),
    "circle_100": (0, 0, 100),
    "circle_1000": (0, 0, 1000),
    "circle_100_fixed": (1, 100, 100),
    "circle_50_fixed": (1, 100, 50),
    "circle_20_fixed": (-118, 62, 20),
}
# centre x, centre y, k, order
NEIGHBOURS = {
    "knn_10": (0, 0, 10, "nearest"),
    "knn_100": (0, 0, 100, "nearest"),
    "knn_1000": (0, 0, 1000, "nearest"),
    "knn_5_fixed": (1, 100, 5, "nearest"),
    "knn_100_fixed": (1, 100, 100, "nearest"),
    "kfar_10": (0, 0, 10, "farthest"),
    "kfar_100": (0, 0, 100, "farthest"),
    "kfar_1000": (0, 0, 1000, "farthest"),
    "kfar_5_fixed": (1, 100, 5, "farthest"),
}
JOINS = {"join_0_1": 0.1, "join_1": 1.0, "join_10": 10.0}

WORKLOAD_SEED, WORKLOAD_SIZE = 7, 0.1
# Factor of the coordinates in queries far from the origin.
WIDE = 1e8


# --- queries -----------------------------------------------------------------


def _box(box, recipe="fine") -> Query:
    return lambda s, d: planar.box_query(fixtures.points(s, d, recipe=recipe), *box)


def _circle(circle) -> Query:
    return lambda s, d: planar.circle_query(fixtures.points(s, d), *circle)


def _knn(cx, cy, k, order, recipe="fine", method="auto") -> Query:
    return lambda s, d: planar.knn(fixtures.points(s, d, recipe=recipe), cx, cy, k, order, method)


def _join(radius, recipe="fine", right="supplier", **options) -> Query:
    return lambda s, d: planar.distance_join(
        fixtures.points(s, d, "events", recipe), fixtures.points(s, d, right, recipe), radius, **options
    )


def _fn_point(s: SparkSession, d: str) -> DataFrame:
    p = fixtures.points(s, d).select("id", planar.point("x", "y").alias("p"))
    return p.select("id", "p.x", "p.y")


def _fn_cast_coord(s: SparkSession, d: str) -> DataFrame:
    text = fixtures.points(s, d).select("id", F.col("x").cast("string"), F.col("y").cast("string"))
    return text.select("id", planar.coord("x").alias("x"), planar.coord("y").alias("y"))


def _fn_envelope(s: SparkSession, d: str) -> DataFrame:
    """A box 18 x 9 from every point, its corners swapped for odd ids."""
    odd = F.col("id") % 2 == 1
    low, high = (F.col("x"), F.col("y")), (F.col("x") + 18.0, F.col("y") + 9.0)
    first = [F.when(odd, h).otherwise(v) for v, h in zip(low, high)]
    second = [F.when(odd, v).otherwise(h) for v, h in zip(low, high)]
    box = planar.envelope(*first, *second)
    return fixtures.points(s, d).select(F.col("id").alias("q"), box.alias("e")).select("q", "e.*")


def _fn_contains(s: SparkSession, d: str) -> DataFrame:
    test = planar.contains(planar.envelope(0, 0, 18, 9), planar.point("x", "y"))
    return fixtures.points(s, d).select("id", test.alias("inside"))


def _fn_distance(s: SparkSession, d: str) -> DataFrame:
    return fixtures.points(s, d).select("id", planar.distance("x", "y", 1, 100).alias("distance"))


def _src_table_points(s: SparkSession, d: str) -> DataFrame:
    return planar.points_from(fixtures.points(s, d), "x", "y", "id")


def _src_csv_points(s: SparkSession, d: str) -> DataFrame:
    path = scratch_path(s, "csv-points")
    fixtures.points(s, d).select("x", "y", "id").write.csv(path)
    return planar.read_csv_points(s, path, id=2).select("id", "x", "y")


def _land_points(s: SparkSession, d: str) -> DataFrame:
    return planar.land_points(fixtures.points(s, d), scratch_path(s, "landed"))


def _land_tiles_circle(s: SparkSession, d: str) -> DataFrame:
    landed = planar.land_points(fixtures.points(s, d), scratch_path(s, "landed"), tile=64.0)
    return planar.circle_query(landed, *CIRCLES["circle_20_fixed"])


def _land_bag(s: SparkSession, d: str) -> DataFrame:
    copies = fixtures.points(s, d, recipe="snap").select("x", "y")
    return planar.land_points(copies, scratch_path(s, "landed"))


def _bucketed(s: SparkSession, d: str, name: str, recipe: str = "fine") -> DataFrame:
    path = scratch_path(s, f"bucketed-{name}")
    table = "bucketed_" + path.rpartition("-")[2]
    return planar.land_bucketed(fixtures.points(s, d, name, recipe), table, 16.0, buckets=8, path=path)


def _join_bucketed(recipe="fine", **options) -> Query:
    return lambda s, d: planar.bucketed_join(
        _bucketed(s, d, "events", recipe), _bucketed(s, d, "supplier", recipe), 10.0, **options)


def _knn_zones(order: str) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        path = scratch_path(s, "zones")
        planar.land_points(fixtures.points(s, d), path, files=16)
        planar.write_zones(s, path)
        return planar.knn_landed(s, path, 0, 0, 100, order)

    return run


def _some_ids(points: DataFrame) -> DataFrame:
    """The points of one half of the plane without their ids."""
    return points.withColumn("id", F.when(F.col("x") > 0, F.col("id")))


def _join_null_ids_hot(s: SparkSession, d: str) -> DataFrame:
    left, right = (_some_ids(fixtures.points(s, d, name, "snap")) for name in ("events", "supplier"))
    pairs = planar.distance_join(left, right, 1.0, strategy="shuffle", block_rows=20)
    return pairs.withColumns({c: F.coalesce(c, F.lit(-1).cast("bigint")) for c in ("a_id", "b_id")})


def _join_self(s: SparkSession, d: str) -> DataFrame:
    points = fixtures.points(s, d)
    return planar.distance_join(points, points, 2.0)


def _batch_box_ranges(recipe="fine", **options) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        ship_code(s)
        return planar.batch_box_ranges(
            fixtures.points(s, d, recipe=recipe), _mixed_boxes(s, d), **options).select("q", "id")

    return run


def _batch_box_count_summed(boxes: Callable[[SparkSession, str], DataFrame], **options) -> Query:
    return lambda s, d: planar.batch_box_count_summed(fixtures.points(s, d), boxes(s, d), **options)


def _sink_view_box(s: SparkSession, d: str) -> DataFrame:
    planar.publish(planar.box_query(fixtures.points(s, d), *BOXES["box_fixed"]), "box_result")
    return s.sql("SELECT * FROM box_result")


def _sink_global_view_join(s: SparkSession, d: str) -> DataFrame:
    planar.publish(_join(10.0)(s, d), "join_result", scope="global")
    return s.sql("SELECT * FROM global_temp.join_result")


def _by_place(points: DataFrame) -> DataFrame:
    """For a join in text, which Spark runs where the few tasks of a small scan read the points."""
    return spread_by_place(points, F.floor(F.col("x") / 10), F.floor(F.col("y") / 10), "x", "y")


def _text(query: str, prepare: Callable[[DataFrame], DataFrame] = lambda points: points) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        planar.register(s)
        a = prepare(fixtures.points(s, d)).selectExpr("id", "x", "y", "ST_Point(x, y) AS p")
        b = fixtures.points(s, d, "supplier").selectExpr("id", "x", "y", "ST_Point(x, y) AS p")
        return s.sql(query, a=a, b=b)

    return run


SQL_BOX = "SELECT id, x, y FROM {a} WHERE ST_Contains(ST_PolygonFromEnvelope(-180.0, 0.0, 0.0, 136.0), p)"
SQL_CIRCLE = "SELECT id, x, y FROM {a} WHERE ST_Distance(ST_Point(-118.0, 62.0), p) < 20"
SQL_KNN = (
    "SELECT id, x, y, ST_Distance(ST_Point(1.0, 100.0), p) AS distance FROM {a} "
    "ORDER BY distance, id LIMIT 5"
)
SQL_JOIN = """
SELECT a.id AS a_id, a.x AS a_x, a.y AS a_y, b.id AS b_id, b.x AS b_x, b.y AS b_y
FROM {a} a
JOIN (SELECT *, explode(cells) AS cell FROM (SELECT *, grid_cells(p, 10) AS cells FROM {b})) b
  ON grid_cell(a.p, 10) = b.cell AND ST_Distance(a.p, b.p) < 10
"""


def _workload(s: SparkSession, d: str) -> DataFrame:
    ids = fixtures.points(s, d, "supplier").select(F.col("id").alias("q"))
    return planar.workload(ids, WORKLOAD_SEED, WORKLOAD_SIZE)


def _workload_box_count(s: SparkSession, d: str) -> DataFrame:
    return planar.batch_box_count(fixtures.points(s, d), _workload(s, d))


def _batch_box(**options) -> Query:
    return lambda s, d: planar.batch_box(fixtures.points(s, d), fixtures.boxes(s, d), **options).select("q", "id")


def _bag(query: Callable[..., DataFrame]) -> Query:
    """A query on copies of few points without an id."""
    return lambda s, d: query(s, d, fixtures.points(s, d, recipe="snap").drop("id"))


def _wide(points: DataFrame, *columns: str) -> DataFrame:
    return points.withColumns({c: F.col(c) * F.lit(WIDE) for c in columns})


def _wide_boxes(s: SparkSession, d: str) -> DataFrame:
    """Boxes of all points, and beyond what they reach."""
    half = F.lit(90.0 * WIDE)
    corners = {c: F.col(c) * F.lit(WIDE) + (half if c in ("x1", "y1") else -half) for c in ("x0", "y0", "x1", "y1")}
    return fixtures.boxes(s, d).withColumns(corners)


def _mixed_boxes(s: SparkSession, d: str) -> DataFrame:
    """Boxes from 18 x 9 to some hundred times that."""
    grow = (F.col("q") * F.col("q")).cast("double")
    return fixtures.boxes(s, d).withColumns({"x1": F.col("x1") + grow, "y1": F.col("y1") + grow / 2})


def _remote(s: SparkSession, d: str) -> DataFrame:
    return fixtures.centres(s, d).withColumn("x", F.col("x") + F.lit(5000.0))


def _raw_view(s: SparkSession, name: str, p: DataFrame) -> None:
    """Headerless text with bad rows, as a view of strings."""
    bad = F.when(F.col("id") % 7 == 0, "not a number").otherwise(F.col("x").cast("string"))
    p.select(F.col("id").cast("string").alias("_c2"), bad.alias("_c0"), F.col("y").cast("string").alias("_c1")).createOrReplaceTempView(name)


RAW_POINTS = "(SELECT CAST(_c2 AS BIGINT) AS id, ST_Point(ST_Coord(_c0), ST_Coord(_c1)) AS p FROM {0})"
SQL_RAW_BOX = (
    f"SELECT id, p.x AS x, p.y AS y FROM {RAW_POINTS.format('raw_points')} "
    "WHERE ST_Contains(ST_PolygonFromEnvelope(-180.0, 0.0, 0.0, 136.0), p)"
)
SQL_RAW_JOIN = f"""
SELECT a.id AS a_id, b.id AS b_id FROM {RAW_POINTS.format('raw_points')} a
JOIN (SELECT *, explode(cells) AS cell FROM (SELECT *, grid_cells(p, 10) AS cells FROM {RAW_POINTS.format('raw_other')})) b
  ON grid_cell(a.p, 10) = b.cell AND ST_Distance(a.p, b.p) < 10
"""


def _raw(query: str, prepare: Callable[[DataFrame], DataFrame] = lambda points: points) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        planar.register(s)
        _raw_view(s, "raw_points", prepare(fixtures.points(s, d)))
        _raw_view(s, "raw_other", fixtures.points(s, d, "supplier"))
        return s.sql(query)

    return run


def _bag_queries() -> dict[str, Query]:
    return {
        "join_bag_shuffle": _bag(lambda s, d, p: planar.distance_join(
            p, fixtures.points(s, d, "supplier", "snap").drop("id"), 1.0, strategy="shuffle", block_rows=500)),
        "knn_bag": _bag(lambda s, d, p: planar.knn(p, 0, 0, 100, method="narrow")),
        "batch_box_bag": _bag(lambda s, d, p: planar.batch_box(p, fixtures.boxes(s, d), strategy="shuffle", block_rows=500)),
        "batch_box_count_bag": _bag(lambda s, d, p: planar.batch_box_count(p, fixtures.boxes(s, d), strategy="shuffle")),
        "batch_knn_bag": _bag(lambda s, d, p: planar.batch_knn(p, fixtures.centres(s, d, "snap"), 10)),
        "batch_kfar_bag": _bag(lambda s, d, p: planar.batch_knn(p, fixtures.centres(s, d, "snap"), 10, order="farthest")),
    }


def _far_queries() -> dict[str, Query]:
    knn = ("q", "id", "distance", "rk")
    return {
        "batch_box_wide": lambda s, d: planar.batch_box(_wide(fixtures.points(s, d), "x", "y"), _wide_boxes(s, d)).select("q", "id"),
        "batch_knn_wide": lambda s, d: planar.batch_knn(
            _wide(fixtures.points(s, d), "x", "y"), _wide(fixtures.centres(s, d), "x", "y"), 10).select(*knn),
        "batch_knn_remote": lambda s, d: planar.batch_knn(fixtures.points(s, d), _remote(s, d), 10).select(*knn),
        "batch_knn_1001": lambda s, d: planar.batch_knn(
            fixtures.points(s, d), fixtures.centres(s, d), 1_001).select(*knn),
        "knn_1001": _knn(0, 0, 1_001, "nearest", method="narrow"),
        "batch_box_mixed": lambda s, d: planar.batch_box(fixtures.points(s, d), _mixed_boxes(s, d)).select("q", "id"),
        "batch_box_mixed_shuffle": lambda s, d: planar.batch_box(
            fixtures.points(s, d), _mixed_boxes(s, d), strategy="shuffle").select("q", "id"),
        "join_many_hot": _join(2.0, right="events", strategy="shuffle", block_rows=2),
        "sql_raw_box": _raw(SQL_RAW_BOX),
        "sql_raw_join": _raw(SQL_RAW_JOIN, _by_place),
    }


def _batch_box_count(s: SparkSession, d: str) -> DataFrame:
    return planar.batch_box_count(fixtures.points(s, d), fixtures.boxes(s, d))


def _batch_circle(s: SparkSession, d: str) -> DataFrame:
    hits = planar.batch_circle(fixtures.points(s, d), fixtures.centres(s, d), 10.0)
    return hits.select("q", "id", "distance")


def _batch_knn(recipe="fine", **options) -> Query:
    return lambda s, d: planar.batch_knn(
        fixtures.points(s, d, recipe=recipe), fixtures.centres(s, d, recipe), 10, **options
    ).select("q", "id", "distance", "rk")


def queries() -> dict[str, Query]:
    return core_queries() | (corpus_queries() if corpus else {})


def corpus_queries() -> dict[str, Query]:
    return corpus.queries() | {"pipeline": corpus_pipeline.run}


def core_queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    out |= {name: _box(box) for name, box in BOXES.items()}
    out["box_18x9_snap"] = _box(BOXES["box_18x9"], "snap")
    out["box_fixed_limit5"] = lambda s, d: _box(BOXES["box_fixed"])(s, d).orderBy("id").limit(5)
    out |= {name: _circle(circle) for name, circle in CIRCLES.items()}
    out["circle_count"] = lambda s, d: planar.count_rows(_circle(CIRCLES["circle_20_fixed"])(s, d))
    out |= {name: _knn(*args) for name, args in NEIGHBOURS.items()}
    out["knn_100_snap"] = _knn(*NEIGHBOURS["knn_100"], recipe="snap")
    out["knn_100_narrow"] = _knn(*NEIGHBOURS["knn_100"], method="narrow")
    out["kfar_100_narrow"] = _knn(*NEIGHBOURS["kfar_100"], recipe="snap", method="narrow")
    out |= {name: _join(radius) for name, radius in JOINS.items()}
    out["join_0_1_snap"] = _join(0.1, "snap")
    out["join_10_broadcast"] = _join(10.0, strategy="broadcast")
    out["join_10_shuffle"] = _join(10.0, strategy="shuffle")
    out["join_snap_blocks"] = _join(1.0, "snap", strategy="shuffle", block_rows=20)
    out["join_self_2"] = _join_self
    # The 25 points of a small table: most cells of the larger one are met by none.
    out["join_sparse"] = _join(1.0, right="nation", strategy="shuffle")
    out["join_null_ids_hot"] = _join_null_ids_hot
    out["join_10_bucketed"] = _join_bucketed()
    out["join_bucketed_hot"] = _join_bucketed("snap", block_rows=50)
    out |= {
        "src_csv_points": _src_csv_points,
        "src_table_points": _src_table_points,
        "land_points": _land_points,
        "land_points_bag": _land_bag,
        "land_tiles_circle": _land_tiles_circle,
        "knn_100_zones": _knn_zones("nearest"),
        "kfar_100_zones": _knn_zones("farthest"),
        "sink_view_box": _sink_view_box,
        "sink_global_view_join": _sink_global_view_join,
        "fn_point": _fn_point,
        "fn_cast_coord": _fn_cast_coord,
        "fn_envelope": _fn_envelope,
        "fn_contains": _fn_contains,
        "fn_distance": _fn_distance,
        "sql_box": _text(SQL_BOX),
        "sql_circle": _text(SQL_CIRCLE),
        "sql_knn": _text(SQL_KNN),
        "sql_join": _text(SQL_JOIN, _by_place),
        "workload": _workload,
        "workload_box_count": _workload_box_count,
        "batch_box": _batch_box(),
        "batch_box_shuffle": _batch_box(strategy="shuffle", block_rows=500),
        "batch_box_count": _batch_box_count,
        "batch_box_ranges": _batch_box_ranges(),
        "batch_box_ranges_parts": _batch_box_ranges("snap", part_rows=500),
        "batch_box_count_summed": _batch_box_count_summed(fixtures.boxes),
        "batch_box_count_summed_mixed": _batch_box_count_summed(_mixed_boxes, strategy="shuffle"),
        "batch_circle": _batch_circle,
        "batch_knn": _batch_knn(),
        "batch_knn_snap": _batch_knn("snap"),
        "batch_knn_shuffle": _batch_knn(strategy="shuffle"),
        "batch_kfar": _batch_knn(order="farthest"),
        "batch_kfar_shuffle": _batch_knn(order="farthest", strategy="shuffle"),
    }
    return out | _bag_queries() | _far_queries()


# --- the same in SQL ---------------------------------------------------------


def _d(v: float) -> str:
    return f"CAST({v} AS DOUBLE)"


def _dist(ax: str, ay: str, bx: str, by: str) -> str:
    return f"sqrt(({ax}-{bx})*({ax}-{bx}) + ({ay}-{by})*({ay}-{by}))"


def _sql_box(box, recipe="fine") -> str:
    x0, y0, x1, y1 = (_d(v) for v in box)
    return (
        f"SELECT id, x, y FROM {fixtures.points_sql(recipe=recipe)} p "
        f"WHERE x > {x0} AND x < {x1} AND y > {y0} AND y < {y1}"
    )


def _sql_circle(circle) -> str:
    cx, cy, r = (_d(v) for v in circle)
    return f"SELECT id, x, y FROM {fixtures.points_sql()} p WHERE {_dist('x', 'y', cx, cy)} < {r}"


def _sql_knn(cx, cy, k, order, recipe="fine") -> str:
    direction = "ASC" if order == "nearest" else "DESC"
    return (
        f"SELECT id, x, y, {_dist('x', 'y', _d(cx), _d(cy))} AS distance "
        f"FROM {fixtures.points_sql(recipe=recipe)} p ORDER BY distance {direction}, id LIMIT {k}"
    )


def _sql_join(radius, recipe="fine", right="supplier") -> str:
    return (
        "SELECT a.id AS a_id, a.x AS a_x, a.y AS a_y, b.id AS b_id, b.x AS b_x, b.y AS b_y "
        f"FROM {fixtures.points_sql('events', recipe)} a JOIN {fixtures.points_sql(right, recipe)} b "
        f"ON {_dist('a.x', 'a.y', 'b.x', 'b.y')} < {_d(radius)}"
    )


def _sql_workload() -> str:
    m = planar.operators.batch._MODULUS
    m0, m1 = planar.operators.batch._MULTIPLIERS
    draws = []
    for i in range(3):
        a = f"((q % {m} * {m0} + {WORKLOAD_SEED * 7919 + (i + 1) * 104729}) % {m})"
        b = f"(({a}*{a} + {a}*{m1}) % {m})"
        draws.append(f"CAST({b} AS DOUBLE)/CAST({m} AS DOUBLE) AS t{i + 1}")
    size = _d(WORKLOAD_SIZE)
    return (
        f"SELECT q, (t1-{size})*{_d(180)} AS x0, (t2-{size})*{_d(90)} AS y0, "
        f"t1*{_d(180)} AS x1, t2*{_d(90)} AS y1, (t1-t2)*{_d(180)} AS cx, (t2-t3)*{_d(90)} AS cy "
        f"FROM (SELECT q, {', '.join(draws)} FROM (SELECT CAST(s_suppkey AS BIGINT) AS q FROM supplier) s) t"
    )


def _sql_batch_box(boxes: str) -> str:
    return (
        f"SELECT q, id FROM {boxes} b JOIN {fixtures.points_sql()} p "
        "ON x > x0 AND x < x1 AND y > y0 AND y < y1"
    )


def _sql_batch_count(boxes: str) -> str:
    return (
        f"SELECT b.q AS q, count(p.id) AS n FROM {boxes} b LEFT JOIN {fixtures.points_sql()} p "
        "ON x > x0 AND x < x1 AND y > y0 AND y < y1 GROUP BY b.q"
    )


def _sql_pairs(recipe="fine") -> str:
    return (
        f"SELECT b.id AS q, a.id AS id, {_dist('a.x', 'a.y', 'b.x', 'b.y')} AS distance "
        f"FROM {fixtures.points_sql('events', recipe)} a CROSS JOIN {fixtures.points_sql('supplier', recipe)} b"
    )


def _sql_batch_knn(recipe="fine") -> str:
    return (
        "SELECT q, id, distance, rk FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY q ORDER BY distance, id) AS rk FROM ({_sql_pairs(recipe)}) pairs) r WHERE rk <= 10"
    )


def oracle_sql() -> dict[str, str]:
    out = core_sql()
    if corpus:
        out |= corpus.oracle_sql()
        if corpus_pipeline.ORACLE_SQL:
            out["pipeline"] = corpus_pipeline.ORACLE_SQL
    return out


def core_sql() -> dict[str, str]:
    points = fixtures.points_sql()
    out: dict[str, str] = {}
    out |= {name: _sql_box(box) for name, box in BOXES.items()}
    out["box_18x9_snap"] = _sql_box(BOXES["box_18x9"], "snap")
    out["box_fixed_limit5"] = _sql_box(BOXES["box_fixed"]) + " ORDER BY id LIMIT 5"
    out |= {name: _sql_circle(circle) for name, circle in CIRCLES.items()}
    out["circle_count"] = f"SELECT count(*) AS n FROM ({_sql_circle(CIRCLES['circle_20_fixed'])}) c"
    out |= {name: _sql_knn(*args) for name, args in NEIGHBOURS.items()}
    out["knn_100_snap"] = _sql_knn(*NEIGHBOURS["knn_100"], "snap")
    out["knn_100_narrow"] = out["knn_100"]
    out["kfar_100_narrow"] = _sql_knn(*NEIGHBOURS["kfar_100"], "snap")
    out |= {name: _sql_join(radius) for name, radius in JOINS.items()}
    out["join_0_1_snap"] = _sql_join(0.1, "snap")
    out["join_10_broadcast"] = out["join_10_shuffle"] = out["join_10"]
    out["join_snap_blocks"] = _sql_join(1.0, "snap")
    out["join_self_2"] = _sql_join(2.0, right="events")
    out["join_sparse"] = _sql_join(1.0, right="nation")
    some = "(SELECT CASE WHEN x > 0 THEN id END AS id, x, y FROM {0} t)"
    out["join_null_ids_hot"] = (
        "SELECT coalesce(a.id, -1) AS a_id, a.x AS a_x, a.y AS a_y, coalesce(b.id, -1) AS b_id, b.x AS b_x, b.y AS b_y "
        f"FROM {some.format(fixtures.points_sql('events', 'snap'))} a JOIN {some.format(fixtures.points_sql('supplier', 'snap'))} b "
        f"ON {_dist('a.x', 'a.y', 'b.x', 'b.y')} < {_d(1.0)}")
    out["join_10_bucketed"] = out["join_10"]
    out["join_bucketed_hot"] = _sql_join(10.0, "snap")
    out["knn_100_zones"], out["kfar_100_zones"] = out["knn_100"], out["kfar_100"]
    every_point = f"SELECT id, x, y FROM {points} p"
    for name in ("src_csv_points", "src_table_points", "land_points", "fn_point"):
        out[name] = every_point
    out["land_points_bag"] = f"SELECT x, y FROM {fixtures.points_sql(recipe='snap')} p"
    out["land_tiles_circle"] = out["circle_20_fixed"]
    out["sink_view_box"] = out["sql_box"] = out["box_fixed"]
    out["sink_global_view_join"] = out["sql_join"] = out["join_10"]
    # Through text: the direct cast of a double is off in the last digits.
    decimal = "CAST(CAST(CAST({0} AS VARCHAR) AS DECIMAL(24,20)) AS DOUBLE) AS {0}"
    out["fn_cast_coord"] = f"SELECT id, {decimal.format('x')}, {decimal.format('y')} FROM {points} p"
    out["fn_envelope"] = (
        f"SELECT id AS q, x AS xmin, y AS ymin, x+{_d(18)} AS xmax, y+{_d(9)} AS ymax FROM {points} p"
    )
    out["fn_contains"] = f"SELECT id, x > 0 AND x < 18 AND y > 0 AND y < 9 AS inside FROM {points} p"
    out["fn_distance"] = f"SELECT id, {_dist('x', 'y', _d(1), _d(100))} AS distance FROM {points} p"
    out["sql_circle"] = out["circle_20_fixed"]
    out["sql_knn"] = out["knn_5_fixed"]
    out["workload"] = _sql_workload()
    out["workload_box_count"] = _sql_batch_count(f"({_sql_workload()})")
    out["batch_box"] = out["batch_box_shuffle"] = _sql_batch_box(fixtures.boxes_sql())
    out["batch_box_count"] = out["batch_box_count_summed"] = _sql_batch_count(fixtures.boxes_sql())
    out["batch_circle"] = f"SELECT q, id, distance FROM ({_sql_pairs()}) pairs WHERE distance < {_d(10)}"
    out["batch_knn"] = out["batch_knn_shuffle"] = _sql_batch_knn()
    out["batch_knn_snap"] = _sql_batch_knn("snap")
    out["batch_kfar"] = out["batch_kfar_shuffle"] = _sql_ranked(_sql_pairs(), 10, order="DESC")
    return out | _sql_bag() | _sql_far()


def _sql_ranked(pairs: str, k: int, ties: str = "id", order: str = "ASC") -> str:
    return (
        f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY distance {order}, {ties}) AS rk "
        f"FROM ({pairs}) pairs) r WHERE rk <= {k}"
    )


def _sql_bag() -> dict[str, str]:
    points, other = fixtures.points_sql(recipe="snap"), fixtures.points_sql("supplier", "snap")
    inside = "x > x0 AND x < x1 AND y > y0 AND y < y1"
    pairs = (
        f"SELECT b.id AS q, a.x AS x, a.y AS y, {_dist('a.x', 'a.y', 'b.x', 'b.y')} AS distance "
        f"FROM {points} a CROSS JOIN {other} b"
    )
    return {
        "join_bag_shuffle": f"SELECT a.x AS a_x, a.y AS a_y, b.x AS b_x, b.y AS b_y FROM {points} a JOIN {other} b "
                            f"ON {_dist('a.x', 'a.y', 'b.x', 'b.y')} < {_d(1.0)}",
        "knn_bag": f"SELECT x, y, {_dist('x', 'y', _d(0), _d(0))} AS distance FROM {points} p ORDER BY distance, x, y LIMIT 100",
        "batch_box_bag": f"SELECT q, x, y FROM {fixtures.boxes_sql()} b JOIN {points} p ON {inside}",
        "batch_box_count_bag": f"SELECT b.q AS q, count(p.x) AS n FROM {fixtures.boxes_sql()} b LEFT JOIN {points} p ON {inside} GROUP BY b.q",
        "batch_knn_bag": _sql_ranked(pairs, 10, "x, y"),
        "batch_kfar_bag": _sql_ranked(pairs, 10, "x, y", "DESC"),
    }


def _sql_far() -> dict[str, str]:
    points, other, boxes = fixtures.points_sql(), fixtures.points_sql("supplier"), fixtures.boxes_sql()
    far, half = _d(WIDE), _d(90.0 * WIDE)

    def wide(table: str, *columns: str) -> str:
        kept = "id, " if table != boxes else "q, "
        return f"(SELECT {kept}" + ", ".join(f"{c} * {far} AS {c}" for c in columns) + f" FROM {table} t)"

    def pairs(a: str, b: str) -> str:
        return (
            f"SELECT b.id AS q, a.id AS id, {_dist('a.x', 'a.y', 'b.x', 'b.y')} AS distance "
            f"FROM {a} a CROSS JOIN {b} b"
        )

    corners = ", ".join(f"{c} * {far} {'+' if c in ('x1', 'y1') else '-'} {half} AS {c}" for c in ("x0", "y0", "x1", "y1"))
    inside = "x > x0 AND x < x1 AND y > y0 AND y < y1"
    mixed = f"(SELECT q, x0, y0, x1 + CAST(q*q AS DOUBLE) AS x1, y1 + CAST(q*q AS DOUBLE) / 2 AS y1 FROM {boxes} t)"
    known = lambda table: f"(SELECT * FROM {table} t WHERE id % 7 <> 0)"
    near = f"{_dist('a.x', 'a.y', 'b.x', 'b.y')} < {_d(10)}"
    out = {
        "batch_box_wide": f"SELECT q, id FROM (SELECT q, {corners} FROM {boxes} t) b JOIN {wide(points, 'x', 'y')} p ON {inside}",
        "batch_knn_wide": _sql_ranked(pairs(wide(points, "x", "y"), wide(other, "x", "y")), 10),
        "batch_knn_remote": _sql_ranked(pairs(points, f"(SELECT id, x + {_d(5000)} AS x, y FROM {other} t)"), 10),
        "batch_knn_1001": _sql_ranked(pairs(points, other), 1_001),
        "knn_1001": _sql_knn(0, 0, 1_001, "nearest"),
        "batch_box_mixed": f"SELECT q, id FROM {mixed} b JOIN {points} p ON {inside}",
        "join_many_hot": _sql_join(2.0, right="events"),
        "sql_raw_box": f"SELECT id, x, y FROM {known(points)} p WHERE x > {_d(-180)} AND x < {_d(0)} AND y > {_d(0)} AND y < {_d(136)}",
        "sql_raw_join": f"SELECT a.id AS a_id, b.id AS b_id FROM {known(points)} a JOIN {known(other)} b ON {near}",
    }
    out["batch_box_mixed_shuffle"] = out["batch_box_mixed"]
    out["batch_box_ranges"] = out["batch_box_mixed"]
    out["batch_box_ranges_parts"] = f"SELECT q, id FROM {mixed} b JOIN {fixtures.points_sql(recipe='snap')} p ON {inside}"
    out["batch_box_count_summed_mixed"] = _sql_batch_count(mixed)
    return out


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: distance join of two point tables."""
    return _join(10.0)(spark, "/root/testdata/sf0.001")
