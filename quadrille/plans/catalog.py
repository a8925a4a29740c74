"""Registered queries over the driver's tables, and their oracle SQL.

Each query takes ``(spark, sf_dir)`` and returns a DataFrame computed on
whole tables.  ``ORACLE_SQL`` holds an independent SQL statement (plain
joins / aggregates, no grid) over the same tables with identical column
names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.sources import fixtures as fx
from quadrille.sources.readers import normalize_boxes
from quadrille.operators.range_query import range_query, range_query_lines
from quadrille.operators.spatial_join import spatial_join, spatial_join_lines
from quadrille.operators.hull import convex_hull, farthest_pair
from quadrille.operators.closest_pair import closest_pair
from quadrille.operators.box_union import union_vertices
from quadrille.plans.session import shared_output_dir
from quadrille.sources.ingest import ingest
from quadrille.sources.sinks import box_csv_lines, pair_lines, point_csv_lines, point_lines, write_result
from quadrille.streaming.continuous import read_box_stream, start_join_lines, window_stream

QueryFn = Callable[[SparkSession, str], DataFrame]

# Window of the flagship range query.
FLAGSHIP_WINDOW = (-0.1, -0.1, 0.1, 0.1)
# Window over the integer boxes.
LINES_WINDOW = (1000, 1000, 7000, 8000)


def q_load_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.f3_points(spark, sf_dir)


def q_load_boxes_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_boxes(fx.f1_boxes(spark, sf_dir))


def q_range_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_query(fx.f1_boxes(spark, sf_dir), FLAGSHIP_WINDOW)


def q_spatial_join_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial_join(fx.f2_pairs(spark, sf_dir), fx.f1_boxes(spark, sf_dir), "inner")


def q_spatial_join_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial_join(fx.f2_pairs(spark, sf_dir), fx.f1_boxes(spark, sf_dir), "left")


def q_spatial_join_multilevel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles of widely mixed sides: several grid levels in one join."""
    return spatial_join(fx.f2_pairs(spark, sf_dir), fx.f6_boxes(spark, sf_dir), "left")


def q_spatial_join_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path of large layers: both sides exchanged on the cell key."""
    return spatial_join(fx.f2_pairs(spark, sf_dir), fx.f6_boxes(spark, sf_dir), "inner", broadcast_limit=0)


def q_spatial_join_crowded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First corners of the pairs against boxes that crowd one corner: crowded cells are cut."""
    points = fx.f2_pairs(spark, sf_dir).select("id", "x1", "y1", F.col("x1").alias("x2"), F.col("y1").alias("y2"))
    return spatial_join(points, fx.f7_boxes(spark, sf_dir), "inner")


def q_range_query_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_query_lines(range_query(fx.f9_boxes(spark, sf_dir), LINES_WINDOW))


def q_convex_hull_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return point_lines(convex_hull(fx.f8_points(spark, sf_dir)), order_by="seq")


def q_farthest_pair_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_lines(farthest_pair(fx.f8_points(spark, sf_dir)))


def q_closest_pair_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_lines(closest_pair(fx.f8_points(spark, sf_dir)), ",  ")


def q_union_vertices_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return point_lines(union_vertices(fx.f9_boxes(spark, sf_dir)), ", ")


def q_union_vertices_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union_vertices(fx.f6_boxes(spark, sf_dir))


def q_spatial_join_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial_join_lines(fx.f2_pairs(spark, sf_dir), fx.f1_boxes(spark, sf_dir))


def q_convex_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convex_hull(fx.f3_points(spark, sf_dir))


def q_farthest_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return farthest_pair(fx.f3_points(spark, sf_dir))


def q_convex_hull_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convex_hull(fx.f5_points(spark, sf_dir))


def q_farthest_pair_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return farthest_pair(fx.f5_points(spark, sf_dir))


def q_closest_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closest_pair(fx.f3_points(spark, sf_dir))


def q_closest_pair_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closest_pair(fx.f4_points(spark, sf_dir))


def q_union_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union_vertices(fx.f1_boxes(spark, sf_dir))


def q_write_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O10: write the box layer as Parquet (overwrite) and read it back."""
    out = shared_output_dir(spark, "write_read_back")
    write_result(fx.f1_boxes(spark, sf_dir), out, "parquet")
    return spark.read.parquet(out)


def q_ingest_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O11: the box layer as comma text, ingested to a sorted Parquet table."""
    base = shared_output_dir(spark, "ingest_boxes")
    write_result(box_csv_lines(fx.f1_boxes(spark, sf_dir)), f"{base}/csv", "text")
    return ingest(spark, f"{base}/csv", f"{base}/table", "boxes")


def q_range_query_ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window query over the box layer after ingest: the corners are plain
    Parquet columns sorted on x1, so all eight bounds reach the scan as
    pushed filters and row groups outside the window are skipped."""
    base = shared_output_dir(spark, "range_query_ingested")
    write_result(box_csv_lines(fx.f1_boxes(spark, sf_dir)), f"{base}/csv", "text")
    ingest(spark, f"{base}/csv", f"{base}/table", "boxes")
    return range_query(spark.read.parquet(f"{base}/table"), FLAGSHIP_WINDOW)


def q_ingest_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1 + O11 for points: the point layer as comma text, ingested and read back."""
    base = shared_output_dir(spark, "ingest_points")
    write_result(point_csv_lines(fx.f3_points(spark, sf_dir)), f"{base}/csv", "text")
    return ingest(spark, f"{base}/csv", f"{base}/table", "points")


def q_stream_range_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window query over the box layer arriving as text files (one file per
    micro-batch), written to a Parquet sink and read back."""
    base = shared_output_dir(spark, "stream_range_query")
    write_result(box_csv_lines(fx.f1_boxes(spark, sf_dir)), f"{base}/in", "text")
    stream = read_box_stream(spark, f"{base}/in", max_files_per_trigger=1)
    q = (window_stream(stream, FLAGSHIP_WINDOW).writeStream.format("parquet")
         .option("path", f"{base}/out").option("checkpointLocation", f"{base}/ckpt")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def q_stream_join_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouped containment join of the corner-pair layer arriving as text
    files against the static box layer, one output folder per micro-batch."""
    base = shared_output_dir(spark, "stream_join_lines")
    write_result(box_csv_lines(fx.f2_pairs(spark, sf_dir)), f"{base}/in", "text")
    stream = read_box_stream(spark, f"{base}/in", max_files_per_trigger=2)
    q = start_join_lines(stream, fx.f1_boxes(spark, sf_dir), f"{base}/out", f"{base}/ckpt",
                         available_now=True)
    q.awaitTermination()
    return spark.read.text(f"{base}/out").select(F.col("value").alias("line"))


# --------------------------------------------------------------------------
# Oracle SQL (DuckDB dialect; tables are pre-registered views)
# --------------------------------------------------------------------------

F1_SQL = """
  SELECT CAST(vec_id AS VARCHAR) AS id,
         CAST(embedding[1] AS DOUBLE) AS x1,
         CAST(embedding[2] AS DOUBLE) AS y1,
         CAST(embedding[1] AS DOUBLE) + 0.1 * CAST(embedding[3] AS DOUBLE) AS x2,
         CAST(embedding[2] AS DOUBLE) + 0.1 * CAST(embedding[4] AS DOUBLE) AS y2
  FROM embeddings"""

F1N_SQL = f"""
  SELECT id, least(x1, x2) AS xmin, least(y1, y2) AS ymin,
         greatest(x1, x2) AS xmax, greatest(y1, y2) AS ymax
  FROM ({F1_SQL}) f1"""

F2_SQL = """
  SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' ||
         CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) AS id,
         l_extendedprice / 200000 - 0.26 AS x1,
         l_quantity / 100 - 0.25 AS y1,
         (l_extendedprice / 200000 - 0.26) + l_discount / 10 AS x2,
         (l_quantity / 100 - 0.25) + l_tax / 10 AS y2
  FROM lineitem"""

F3_SQL = """
  SELECT CAST(vec_id AS VARCHAR) AS id,
         CAST(embedding[1] AS DOUBLE) AS x,
         CAST(embedding[2] AS DOUBLE) AS y
  FROM embeddings"""

F4_SQL = """
  SELECT CAST(l_extendedprice AS DOUBLE) AS x, CAST(l_quantity AS DOUBLE) AS y
  FROM lineitem"""

# Strict hull vertices are ends of their row, so only the ends of each y stay:
# the brute-force SQL below then runs over at most two points per y.
F5_SQL = """
  SELECT unnest([min(x), max(x)]) AS x, y FROM (
    SELECT CAST(round(l_extendedprice * 100) AS DOUBLE) AS x, CAST(round(l_quantity) AS DOUBLE) AS y
    FROM lineitem) s GROUP BY y"""

STRICT_SQL = """r.xmin < p.x1 AND p.x1 < r.xmax AND r.xmin < p.x2 AND p.x2 < r.xmax
   AND r.ymin < p.y1 AND p.y1 < r.ymax AND r.ymin < p.y2 AND p.y2 < r.ymax"""

F6_SQL = f"""
  SELECT id, x1, y1, x1 + side AS x2, y1 + side AS y2 FROM (
    SELECT CAST(p_partkey AS VARCHAR) AS id,
           (p_partkey * 7919 % 10007) / 20014 - CAST(0.26 AS DOUBLE) AS x1,
           (p_partkey * 104729 % 10009) / 20018 - CAST(0.25 AS DOUBLE) AS y1,
           CAST({list(fx.F6_SIDES)}[p_size % {len(fx.F6_SIDES)} + 1] AS DOUBLE) AS side
    FROM part) s"""

F6N_SQL = f"""
  SELECT id, x1 AS xmin, y1 AS ymin, x2 AS xmax, y2 AS ymax FROM ({F6_SQL}) f6"""


F7N_SQL = """
  SELECT id, x1 AS xmin, y1 AS ymin, x1 + side AS xmax, y1 + side AS ymax FROM (
    SELECT CAST(p_partkey AS VARCHAR) AS id,
           CASE WHEN p_partkey % 5 < 2 THEN (p_partkey * 7919 % 10007) / 1250875 - CAST(0.24 AS DOUBLE)
                ELSE (p_partkey * 7919 % 10007) / 20014 - CAST(0.26 AS DOUBLE) END AS x1,
           CASE WHEN p_partkey % 5 < 2 THEN (p_partkey * 104729 % 10009) / 1251125 - CAST(0.204 AS DOUBLE)
                ELSE (p_partkey * 104729 % 10009) / 20018 - CAST(0.25 AS DOUBLE) END AS y1,
           CASE WHEN p_partkey % 5 < 2 THEN CAST(0.0002 AS DOUBLE) ELSE CAST(0.004 AS DOUBLE) END AS side
    FROM part) s"""

F8_SQL = """
  SELECT CAST(round(l_extendedprice) AS DOUBLE) AS x, CAST(round(l_quantity) AS DOUBLE) AS y FROM lineitem"""

# the ends of each row, as for F5
F8_ENDS_SQL = f"SELECT unnest([min(x), max(x)]) AS x, y FROM ({F8_SQL}) s GROUP BY y"

F9_SQL = """
  SELECT id, x1, y1, x1 + side AS x2, y1 + side AS y2 FROM (
    SELECT CAST(p_partkey AS VARCHAR) AS id, CAST(p_partkey * 7919 % 10007 AS DOUBLE) AS x1,
           CAST(p_partkey * 104729 % 10009 AS DOUBLE) AS y1, CAST(p_size AS DOUBLE) AS side
    FROM part) s"""


def pair_lines_sql(pair: str, sep: str) -> str:
    """Both points of a pair, a line each."""
    return f"SELECT unnest([concat(x1, '{sep}', y1), concat(x2, '{sep}', y2)]) AS line FROM ({pair}) pair"


def distinct_points_sql(src: str) -> str:
    return f"SELECT DISTINCT x, y FROM ({src}) s WHERE isfinite(x) AND isfinite(y)"


def hull_sql(src: str) -> str:
    """Strict hull vertices by the edge test: p is a vertex when some q
    leaves every point left of p->q or on the closed segment [p, q]."""
    cr = "((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x))"
    return f"""
  WITH pts AS ({distinct_points_sql(src)}),
  hv AS (
    SELECT DISTINCT p.x, p.y FROM pts p JOIN pts q ON (p.x <> q.x OR p.y <> q.y)
    WHERE NOT EXISTS (
      SELECT 1 FROM pts r
      WHERE {cr} < 0
         OR ({cr} = 0 AND ((r.x - p.x) * (q.x - p.x) + (r.y - p.y) * (q.y - p.y) < 0
                        OR (r.x - q.x) * (p.x - q.x) + (r.y - q.y) * (p.y - q.y) < 0)))
  ),
  v0 AS (SELECT x, y FROM hv ORDER BY x, y LIMIT 1)
  SELECT row_number() OVER (ORDER BY (hv.x = v0.x AND hv.y = v0.y) DESC,
                                     atan2(hv.y - v0.y, hv.x - v0.x) DESC) - 1 AS seq,
         hv.x AS x, hv.y AS y
  FROM hv CROSS JOIN v0"""


def pair_sql(src: str, farthest: bool) -> str:
    le = "<=" if farthest else "<"
    order = "d2 DESC" if farthest else "d2"
    return f"""
  WITH pts AS ({distinct_points_sql(src)}),
  pr AS (
    SELECT a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2,
           (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2
    FROM pts a JOIN pts b ON (a.x < b.x OR (a.x = b.x AND a.y {le} b.y)))
  SELECT x1, y1, x2, y2, d2, sqrt(d2) AS dist FROM pr
  ORDER BY {order}, x1, y1, x2, y2 LIMIT 1"""


def banded_closest_sql(src: str) -> str:
    """Closest pair by an x-banded self-join.  The band is the distance of
    a real pair (the closest of the pairs adjacent in (x, y) order), so no
    pair at the minimum distance can fall outside it."""
    return f"""
  WITH pts AS ({distinct_points_sql(src)}),
  ord AS (SELECT x, y, lead(x) OVER (ORDER BY x, y) AS nx, lead(y) OVER (ORDER BY x, y) AS ny
          FROM pts),
  band AS (SELECT sqrt(min((nx - x) * (nx - x) + (ny - y) * (ny - y))) * 1.000001 AS b
           FROM ord WHERE nx IS NOT NULL),
  pr AS (
    SELECT a.x AS x1, a.y AS y1, c.x AS x2, c.y AS y2,
           (a.x - c.x) * (a.x - c.x) + (a.y - c.y) * (a.y - c.y) AS d2
    FROM pts a CROSS JOIN band
    JOIN pts c ON c.x >= a.x AND c.x <= a.x + band.b
              AND (a.x < c.x OR (a.x = c.x AND a.y < c.y)))
  SELECT x1, y1, x2, y2, d2, sqrt(d2) AS dist FROM pr
  ORDER BY d2, x1, y1, x2, y2 LIMIT 1"""


def union_sql(src: str) -> str:
    """Union vertices by brute force: every corner and every crossing of a
    vertical edge with a horizontal edge, then the quadrant test."""
    return f"""
  WITH b AS (
    SELECT DISTINCT least(x1, x2) AS xmin, least(y1, y2) AS ymin,
           greatest(x1, x2) AS xmax, greatest(y1, y2) AS ymax
    FROM ({src}) s
    WHERE isfinite(x1) AND isfinite(y1) AND isfinite(x2) AND isfinite(y2)
      AND x1 <> x2 AND y1 <> y2),
  v AS (SELECT xmin AS x, ymin AS y0, ymax AS y1 FROM b
        UNION ALL SELECT xmax, ymin, ymax FROM b),
  h AS (SELECT ymin AS y, xmin AS x0, xmax AS x1 FROM b
        UNION ALL SELECT ymax, xmin, xmax FROM b),
  cand AS (
    SELECT v.x, h.y FROM v JOIN h
      ON h.x0 <= v.x AND v.x <= h.x1 AND v.y0 <= h.y AND h.y <= v.y1
    GROUP BY v.x, h.y),
  cov AS (
    SELECT c.x, c.y,
      max(CASE WHEN b.xmin <= c.x AND c.x < b.xmax AND b.ymin <= c.y AND c.y < b.ymax THEN 1 ELSE 0 END) AS ne,
      max(CASE WHEN b.xmin < c.x AND c.x <= b.xmax AND b.ymin <= c.y AND c.y < b.ymax THEN 1 ELSE 0 END) AS nw,
      max(CASE WHEN b.xmin <= c.x AND c.x < b.xmax AND b.ymin < c.y AND c.y <= b.ymax THEN 1 ELSE 0 END) AS se,
      max(CASE WHEN b.xmin < c.x AND c.x <= b.xmax AND b.ymin < c.y AND c.y <= b.ymax THEN 1 ELSE 0 END) AS sw
    FROM cand c JOIN b
      ON b.xmin <= c.x AND c.x <= b.xmax AND b.ymin <= c.y AND c.y <= b.ymax
    GROUP BY c.x, c.y)
  SELECT x, y FROM cov
  WHERE ne + nw + se + sw IN (1, 3) OR (ne + nw + se + sw = 2 AND ne = sw)"""


ORACLE_SQL: dict[str, str] = {
    "load_points": F3_SQL,
    "load_boxes_normalized": F1N_SQL,
    "range_query": f"""
  SELECT * FROM ({F1_SQL}) f1
  WHERE least(x1, x2) >= -0.1 AND greatest(x1, x2) <= 0.1
    AND least(y1, y2) >= -0.1 AND greatest(y1, y2) <= 0.1""",
    "spatial_join_pairs": f"""
  SELECT p.*, r.id AS rect_id, r.xmin AS rect_xmin, r.ymin AS rect_ymin,
         r.xmax AS rect_xmax, r.ymax AS rect_ymax
  FROM ({F2_SQL}) p JOIN ({F1N_SQL}) r
    ON {STRICT_SQL}""",
    "spatial_join_left": f"""
  SELECT p.*, r.id AS rect_id, r.xmin AS rect_xmin, r.ymin AS rect_ymin,
         r.xmax AS rect_xmax, r.ymax AS rect_ymax
  FROM ({F2_SQL}) p LEFT JOIN ({F1N_SQL}) r
    ON {STRICT_SQL}""",
    "spatial_join_multilevel": f"""
  SELECT p.*, r.id AS rect_id, r.xmin AS rect_xmin, r.ymin AS rect_ymin,
         r.xmax AS rect_xmax, r.ymax AS rect_ymax
  FROM ({F2_SQL}) p LEFT JOIN ({F6N_SQL}) r
    ON {STRICT_SQL}""",
    "spatial_join_shuffled": f"""
  SELECT p.*, r.id AS rect_id, r.xmin AS rect_xmin, r.ymin AS rect_ymin,
         r.xmax AS rect_xmax, r.ymax AS rect_ymax
  FROM ({F2_SQL}) p JOIN ({F6N_SQL}) r
    ON {STRICT_SQL}""",
    "spatial_join_crowded": f"""
  SELECT p.*, r.id AS rect_id, r.xmin AS rect_xmin, r.ymin AS rect_ymin,
         r.xmax AS rect_xmax, r.ymax AS rect_ymax
  FROM (SELECT id, x1, y1, x1 AS x2, y1 AS y2 FROM ({F2_SQL}) f2) p JOIN ({F7N_SQL}) r
    ON {STRICT_SQL}""",
    "range_query_lines": f"""
  SELECT concat('ID: ', id, '  Coordinates:  ', x1, ', ', y1, ';   ', x2, ',  ', y2) AS line
  FROM ({F9_SQL}) f9 WHERE x1 >= 1000 AND x2 <= 7000 AND y1 >= 1000 AND y2 <= 8000""",
    "convex_hull_lines": f"SELECT concat(x, ',  ', y) AS line FROM ({hull_sql(F8_ENDS_SQL)}) h",
    "farthest_pair_lines": pair_lines_sql(pair_sql(F8_ENDS_SQL, farthest=True), ","),
    "closest_pair_lines": pair_lines_sql(banded_closest_sql(F8_SQL), ",  "),
    "union_vertices_lines": f"SELECT concat(x, ', ', y) AS line FROM ({union_sql(F9_SQL)}) u",
    "union_vertices_dense": union_sql(F6_SQL),
    "spatial_join_lines": f"""
  SELECT p.id || ': ' || coalesce(string_agg(r.id, ',' ORDER BY r.xmin, r.id), '') AS line
  FROM ({F2_SQL}) p LEFT JOIN ({F1N_SQL}) r
    ON {STRICT_SQL}
  GROUP BY p.id, p.x1, p.y1, p.x2, p.y2""",
    "convex_hull": hull_sql(F3_SQL),
    "farthest_pair": pair_sql(F3_SQL, farthest=True),
    "convex_hull_lineitem": hull_sql(F5_SQL),
    "farthest_pair_lineitem": pair_sql(F5_SQL, farthest=True),
    "closest_pair": pair_sql(F3_SQL, farthest=False),
    "closest_pair_lineitem": banded_closest_sql(F4_SQL),
    "union_vertices": union_sql(F1_SQL),
    "write_read_back": F1_SQL,
    "ingest_boxes": F1_SQL,
    "ingest_points": F3_SQL,
}
ORACLE_SQL["stream_range_query"] = ORACLE_SQL["range_query"]
ORACLE_SQL["range_query_ingested"] = ORACLE_SQL["range_query"]
ORACLE_SQL["stream_join_lines"] = ORACLE_SQL["spatial_join_lines"]

QUERIES: dict[str, QueryFn] = {
    "load_points": q_load_points,
    "load_boxes_normalized": q_load_boxes_normalized,
    "range_query": q_range_query,
    "spatial_join_pairs": q_spatial_join_pairs,
    "spatial_join_left": q_spatial_join_left,
    "spatial_join_multilevel": q_spatial_join_multilevel,
    "spatial_join_shuffled": q_spatial_join_shuffled,
    "spatial_join_crowded": q_spatial_join_crowded,
    "range_query_lines": q_range_query_lines,
    "convex_hull_lines": q_convex_hull_lines,
    "farthest_pair_lines": q_farthest_pair_lines,
    "closest_pair_lines": q_closest_pair_lines,
    "union_vertices_lines": q_union_vertices_lines,
    "union_vertices_dense": q_union_vertices_dense,
    "spatial_join_lines": q_spatial_join_lines,
    "convex_hull": q_convex_hull,
    "farthest_pair": q_farthest_pair,
    "convex_hull_lineitem": q_convex_hull_lineitem,
    "farthest_pair_lineitem": q_farthest_pair_lineitem,
    "closest_pair": q_closest_pair,
    "closest_pair_lineitem": q_closest_pair_lineitem,
    "union_vertices": q_union_vertices,
    "write_read_back": q_write_read_back,
    "ingest_boxes": q_ingest_boxes,
    "ingest_points": q_ingest_points,
    "range_query_ingested": q_range_query_ingested,
    "stream_range_query": q_stream_range_query,
    "stream_join_lines": q_stream_join_lines,
}

LINE_FORMS = ("range_query_lines", "convex_hull_lines", "farthest_pair_lines", "closest_pair_lines", "union_vertices_lines")

# Queries timed by bench.py: the operators themselves (the streaming keys
# re-run the same operators behind a file source and add source start-up, and
# the two joins over mixed sides mostly time the rows they return; the line
# formats only print what other keys time).
BENCH_KEYS = [k for k in QUERIES if not k.startswith("stream_") and not k.startswith(LINE_FORMS)
              and k not in ("spatial_join_multilevel", "spatial_join_shuffled")]
