"""Queries over large tables of planar points, on Spark DataFrames."""

from planar.functions.exprs import contains, coord, distance, envelope, inside, point
from planar.functions.sqlfuncs import register
from planar.operators.batch import batch_box, batch_box_count, batch_circle, batch_knn, workload
from planar.operators.bucketed import bucketed_join
from planar.operators.join import distance_join, self_join
from planar.operators.knn import knn
from planar.operators.range import box_query, circle_query, count_rows
from planar.operators.summed import batch_box_count_summed
from planar.operators.zranges import batch_box_ranges
from planar.sources.bucketed import land_bucketed, read_bucketed
from planar.sources.landing import land_points, read_landed
from planar.sources.readers import points_from, read_csv_points, read_raw_csv
from planar.sources.sinks import publish
from planar.sources.zones import knn_landed, write_zones

__all__ = [
    "batch_box", "batch_box_count", "batch_box_count_summed", "batch_box_ranges", "batch_circle", "batch_knn",
    "box_query", "bucketed_join", "circle_query", "contains", "coord", "count_rows", "distance",
    "distance_join", "envelope", "inside", "knn", "knn_landed", "land_bucketed", "land_points",
    "point", "points_from", "publish", "read_bucketed", "read_csv_points", "read_landed",
    "read_raw_csv", "register", "self_join", "workload", "write_zones",
]
