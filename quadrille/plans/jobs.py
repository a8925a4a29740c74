"""End-to-end jobs, one per reference program: read a text layer, run the
operator, write the result lines (overwrite), return the written path.

Run with ``spark-submit -m``-style launchers as
``python -m quadrille.plans.jobs <job> <input...> <output> [options]``.
Output is written in parallel unless ``single_file`` is asked for (the
reference always wrote one part file; that is opt-in here because it
funnels the whole result through one task).
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from quadrille.operators.box_union import union_vertices
from quadrille.operators.closest_pair import closest_pair
from quadrille.operators.hull import convex_hull, farthest_pair
from quadrille.operators.range_query import range_query, range_query_lines
from quadrille.operators.spatial_join import spatial_join_lines
from quadrille.sources.readers import read_boxes, read_points
from quadrille.sources.sinks import pair_lines, point_lines, write_result

# Separators of the reference's output lines (fixed values).
HULL_SEP = ",  "
FARTHEST_SEP = ","
CLOSEST_SEP = ",  "
UNION_SEP = ", "


def _write(lines: DataFrame, output: str, single_file: bool) -> str:
    return write_result(lines, output, "text", single_file=single_file)


def range_query_job(spark: SparkSession, boxes_path: str, output: str, window,
                    on_bad: str = "fail", single_file: bool = False) -> str:
    res = range_query(read_boxes(spark, boxes_path, on_bad=on_bad), window)
    return _write(range_query_lines(res), output, single_file)


def spatial_join_job(spark: SparkSession, pairs_path: str, rects_path: str, output: str,
                     on_bad: str = "fail", single_file: bool = False) -> str:
    lines = spatial_join_lines(read_boxes(spark, pairs_path, on_bad=on_bad),
                               read_boxes(spark, rects_path, on_bad=on_bad))
    return _write(lines, output, single_file)


def convex_hull_job(spark: SparkSession, points_path: str, output: str, on_bad: str = "fail",
                    single_file: bool = False) -> str:
    hull = convex_hull(read_points(spark, points_path, on_bad=on_bad))
    return _write(point_lines(hull, HULL_SEP, order_by="seq"), output, single_file)


def farthest_pair_job(spark: SparkSession, points_path: str, output: str, on_bad: str = "fail",
                      single_file: bool = False) -> str:
    res = farthest_pair(read_points(spark, points_path, on_bad=on_bad))
    return _write(pair_lines(res, FARTHEST_SEP), output, single_file)


def closest_pair_job(spark: SparkSession, points_path: str, output: str, on_bad: str = "fail",
                     single_file: bool = False) -> str:
    res = closest_pair(read_points(spark, points_path, on_bad=on_bad))
    return _write(pair_lines(res, CLOSEST_SEP), output, single_file)


def union_job(spark: SparkSession, boxes_path: str, output: str, on_bad: str = "fail",
              single_file: bool = False) -> str:
    res = union_vertices(read_boxes(spark, boxes_path, on_bad=on_bad))
    return _write(point_lines(res, UNION_SEP), output, single_file)


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="quadrille.plans.jobs")
    ap.add_argument("job", choices=["range", "join", "hull", "farthest", "closest", "union"])
    ap.add_argument("paths", nargs="+", help="input path(s) then the output folder")
    ap.add_argument("--window", type=float, nargs=4, metavar=("X1", "Y1", "X2", "Y2"))
    ap.add_argument("--on-bad", default="fail", choices=["fail", "drop"])
    ap.add_argument("--single-file", action="store_true")
    a = ap.parse_args(argv)
    spark = SparkSession.builder.appName(f"quadrille-{a.job}").getOrCreate()
    *inputs, out = a.paths
    kw = {"on_bad": a.on_bad}
    if a.single_file:
        kw["single_file"] = True
    if a.job == "range":
        if not a.window:
            ap.error("range needs --window")
        range_query_job(spark, inputs[0], out, a.window, **kw)
    elif a.job == "join":
        spatial_join_job(spark, inputs[0], inputs[1], out, **kw)
    else:
        {"hull": convex_hull_job, "farthest": farthest_pair_job, "closest": closest_pair_job,
         "union": union_job}[a.job](spark, inputs[0], out, **kw)


if __name__ == "__main__":
    main()
