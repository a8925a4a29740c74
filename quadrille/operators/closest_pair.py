"""O8: closest pair of distinct points.

Plan
----
1. Finite points, ``distinct`` (partial aggregation folds heavy copies
   map-side), checkpointed once because several passes read them; the
   count and bounding box are observed in that same job.
2. An upper bound ``g`` on the closest distance: start with the extent
   ``w + h`` (>= any pair distance), then refine.  While a cell of side
   ``g`` may hold ``m > K_MAX`` points, a finer grid of side ``g / k`` with
   ``(k + 2)**2 < m`` must put two of them in one fine cell (pigeonhole,
   with a cell of slack for rounding), so the min over fine cells of the
   distance between the cell's smallest and largest point is a real pair
   distance below ``~ 1.5 g / k``.  Each round is one partial-aggregated
   ``groupBy``; only scalars reach the driver.
3. Points within distance ``g`` of each other lie in the same or adjacent cells
   of any side of ``g`` or more.  Cells ``WIDE`` times as wide are used: a point
   goes to its own cell, and only if it lies within ``g`` of the cell's right,
   upper or upper left border also to the neighbours there, so about 1.3 rows a
   point are exchanged.  Sorted by cell and x, each partition streams through in
   batches: a point meets those that follow it in its cell within ``g`` on x (a
   cell of side ``g`` holds few, so these are few), and every task keeps its best
   pair.  A distributed top-1 ordered by ``d2, x1, y1, x2, y2`` picks the answer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions.geometry import squared_distance
from quadrille.operators.hull import finite_points
from quadrille.plans.session import materialize_with_stats, shuffle_partitions_for

K_MAX = 64
SLACK = 1.0 + 1e-9
WIDE = 16.0  # side of the cells in which pairs are formed, in bounds
PAIR_COLS = ("x1", "y1", "x2", "y2", "d2", "dist")
ROW_BYTES = 48  # x, y, cell key and row overhead on the build side


def _cells(pts: DataFrame, size: float) -> DataFrame:
    s = F.lit(float(size))
    return pts.withColumn("_cx", F.floor(F.col("x") / s)).withColumn("_cy", F.floor(F.col("y") / s))


def _fine_round(pts: DataFrame, size: float) -> tuple[float | None, int]:
    """One aggregate over fine cells of side ``size``: the min distance
    between two distinct points of any cell holding two or more (a real
    pair, so an upper bound), and the fullest cell's count.

    The two points are the cell's leftmost and rightmost (any y), or, when
    all share one x, its lowest and highest; only double-valued aggregates
    are used, which stay on the fast aggregation path.
    """
    g = (_cells(pts, size).groupBy("_cx", "_cy")
         .agg(F.count(F.lit(1)).alias("n"),
              F.min("x").alias("x0"), F.max("x").alias("x1"),
              F.min_by("y", "x").alias("y0"), F.max_by("y", "x").alias("y1"),
              F.min("y").alias("ylo"), F.max("y").alias("yhi")))
    spread = F.col("ylo") - F.col("yhi")
    d2 = F.when(F.col("n") < 2, F.lit(None)).when(
        F.col("x0") < F.col("x1"),
        squared_distance(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))).otherwise(spread * spread)
    row = g.agg(F.min(d2).alias("d2"), F.max("n").alias("m")).first()
    return (None if row["d2"] is None else math.sqrt(row["d2"])), int(row["m"] or 0)


def _empty(pts: DataFrame) -> DataFrame:
    return pts.where(F.lit(False)).select(
        F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("x").alias("x2"),
        F.col("y").alias("y2"), F.lit(0.0).alias("d2"), F.lit(0.0).alias("dist"))


def distance_bound(pts: DataFrame, stats) -> float:
    """Cell side ``g`` >= closest distance, with cells of side ``g`` holding
    about K_MAX points or fewer.

    ``est`` is an upper bound on the fullest cell of side ``g``: ``n`` for the
    extent, then ``9 * m`` where ``m`` is the fullest fine cell of the last
    round (the new ``g`` is below 1.5 fine cells, so a cell of side ``g``
    overlaps at most 3 x 3 fine cells).  Each round is one aggregate.

    ``est`` may be far too high (points on a lattice), so that no fine cell
    holds two points; then the fine cells are made twice as wide, until some
    do or a cell of side ``g`` provably holds few.
    """
    g = (stats["x1"] - stats["x0"]) + (stats["y1"] - stats["y0"])
    max_abs = max(abs(stats["x0"]), abs(stats["x1"]), abs(stats["y0"]), abs(stats["y1"]), 1e-300)
    est, k = int(stats["n"]), None
    while est > K_MAX:
        if k is None:
            # (k + 2)**2 < est fine cells (one cell of slack per axis for
            # rounding) force two points of the fullest cell into one fine cell
            k = max(2, int(math.isqrt(est - 1)) - 2)
            # keep fine cell indices well inside 64 bits
            k = max(2, min(k, int(2.0 ** 52 * g / max_abs)))
        d, m = _fine_round(pts, g / k)
        if d is not None and d < g:
            g, est, k = d, 9 * m, None
        elif k > 2:
            est, k = min(est, (k + 2) ** 2), k // 2  # one point per fine cell at most
        else:
            break  # a cell of side g overlaps 4 x 4 fine cells of one point each at most
    return g


def with_border_copies(pts: DataFrame, bound: float, max_abs: float) -> DataFrame:
    """``x, y, _cx, _cy``: every point in its wide cell, and near the right, upper
    or upper left border in the neighbours behind it too.

    Two points within ``bound`` then share a cell: of two cells next to each other
    the later one (by row, then column) holds copies of the earlier one's border.
    """
    side = bound * WIDE
    near = bound + 4.0 * max_abs * 2.0 ** -52  # rounding of a border's place
    own = _cells(pts, side)
    right = F.col("x") >= (F.col("_cx") + 1) * F.lit(side) - F.lit(near)
    left = F.col("x") <= F.col("_cx") * F.lit(side) + F.lit(near)
    up = F.col("y") >= (F.col("_cy") + 1) * F.lit(side) - F.lit(near)
    steps = [(F.lit(True), 0, 0), (right, 1, 0), (up, 0, 1), (up & right, 1, 1), (up & left, -1, 1)]
    to = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"))) for c, i, j in steps]))
    out = own.select("x", "y", "_cx", "_cy", F.explode(to).alias("to"))
    return out.select("x", "y", (F.col("_cx") + F.col("to.i")).alias("_cx"), (F.col("_cy") + F.col("to.j")).alias("_cy"))


def nearest_in_cells(bound: float):
    """Over rows sorted by cell and x: the best pair that shares a cell, if any."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        held = [np.zeros(0) for _ in range(2)] + [np.zeros(0, np.int64) for _ in range(2)]
        for batch in batches:
            x, y, cx, cy = (np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("x", "y", "_cx", "_cy")))
            step, at = 1, np.arange(len(x))
            while True:  # pairs ``step`` rows apart, of the rows that still have one in reach
                at = at[at + step < len(x)]
                to = at + step
                reach = (cx[at] == cx[to]) & (cy[at] == cy[to]) & (x[to] - x[at] <= bound)
                at, to = at[reach], to[reach]
                if not len(at):
                    break
                dx, dy = x[at] - x[to], y[at] - y[to]
                d2 = dx * dx + dy * dy
                least = d2.min()
                if best is None or least <= best[0]:
                    for i in np.flatnonzero(d2 == least).tolist():
                        p, q = sorted([(x[at[i]], y[at[i]]), (x[to[i]], y[to[i]])])
                        best = min(best or (np.inf,), (least, *p, *q))
                step += 1
            if len(x):
                kept = (cx == cx[-1]) & (cy == cy[-1]) & (x >= x[-1] - bound)
                held = [v[kept] for v in (x, y, cx, cy)]
        if best is not None:
            yield pa.RecordBatch.from_pydict({n: [float(v)] for n, v in zip(("x1", "y1", "x2", "y2", "d2"), (*best[1:], best[0]))})

    return look


def closest_pair(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """One row ``(x1, y1, x2, y2, d2, dist)``: the nearest two distinct points.

    ``(x1, y1) < (x2, y2)``; ties go to the smallest ``(x1, y1, x2, y2)``.
    Fewer than two distinct finite points give no row.
    """
    pts, st = materialize_with_stats(
        finite_points(points, x, y).distinct(),
        F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"),
        F.min("y").alias("y0"), F.max("y").alias("y1"))
    if st["n"] < 2:
        return _empty(pts)
    bound = distance_bound(pts, st) * SLACK
    # enough partitions that each stays near TARGET_BYTES at any scale
    parts = shuffle_partitions_for(pts.sparkSession, int(st["n"]) * ROW_BYTES)
    cells = with_border_copies(pts, bound, max(abs(st[c]) for c in ("x0", "x1", "y0", "y1")))
    cells = cells.repartition(parts, "_cx", "_cy").sortWithinPartitions("_cx", "_cy", "x")
    pairs = cells.mapInArrow(nearest_in_cells(bound), "x1 double, y1 double, x2 double, y2 double, d2 double")
    top = pairs.orderBy("d2", "x1", "y1", "x2", "y2").limit(1)
    return top.withColumn("dist", F.sqrt("d2")).select(*PAIR_COLS)
