"""O9: vertex set of the union of axis-aligned boxes.

The output is the distinct set of points where the boundary of the union
turns (shell and hole corners alike), as ``(x, y)``.

A point is a vertex when, of the four open quadrants next to it, 1 or 3 are
covered by boxes, or 2 diagonal ones (two boxes touching at a corner).  Two
adjacent covered quadrants are a straight edge, 0 or 4 are outside or inside.

Plan
----
Boxes are normalised, cleaned (NULL/NaN/infinite and zero-area boxes contribute
nothing) and deduplicated.  The plane is cut into half-open square cells whose
side is a power of two, so that cell indices are exact at every side:

1. A start side follows the number of boxes, no finer than keeps the copies of
   boxes in cells at a few a box.  Each box is copied into the cells it touches
   and *clipped* there: a side outside a cell becomes the same value for all
   boxes, so nested boxes that look alike inside a cell are one row, and a cell
   that one box covers is dropped with all its rows.
2. Cells with more than ``cell_boxes`` distinct clipped boxes are cut into 8 x 8
   smaller ones, round by round, as in a quadtree.  Only crowded cells are cut,
   and sides of boxes that differ come apart, so every cell gets under the limit
   however dense or skewed the input is; no group ever holds more rows.
3. Each cell is then solved by itself: the coordinates inside it cut it into
   strips, running sums of the boxes' corner marks tell which rectangles of the
   strips are covered (by one box or by several together), and the four
   rectangles around every crossing of two coordinates decide.  No box is joined
   with another, and a point lies in one cell only, so nothing is emitted twice.

Nothing is broadcast, and the driver sees a few numbers a round.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions.geometry import all_of, is_finite
from quadrille.plans.session import materialize, materialize_with_stats

BOUNDS = ("xmin", "ymin", "xmax", "ymax")
CELL = ("cx", "cy")
CELL_BOXES = 128  # distinct clipped boxes of a cell that is solved at once
SPLIT = 8  # cells a crowded cell is cut into, per axis (a power of two)
COPIES = 4  # cells a box may start in, on average
DEEPEST = 50  # halvings of the extent: cell indices stay exact


def prepare_boxes(boxes: DataFrame, x1="x1", y1="y1", x2="x2", y2="y2") -> DataFrame:
    """Distinct finite boxes of positive area as ``xmin, ymin, xmax, ymax``."""
    b = boxes.select(F.least(x1, x2).alias("xmin"), F.least(y1, y2).alias("ymin"),
                     F.greatest(x1, x2).alias("xmax"), F.greatest(y1, y2).alias("ymax"))
    b = b.where(all_of([is_finite(c) for c in BOUNDS])
                & (F.col("xmin") < F.col("xmax")) & (F.col("ymin") < F.col("ymax")))
    return b.distinct()


def start_side(stats: dict, cell_boxes: int, cell: float | None) -> tuple[float, float]:
    """``(start, least)``: powers of two.  Cells of the start side hold about
    ``cell_boxes`` boxes if these are spread evenly."""
    extent = max(abs(stats["lo"]), abs(stats["hi"]), 5e-324)
    top = 2.0 ** min(1023, math.ceil(math.log2(extent)) + 1)
    least = max(top * 2.0 ** -DEEPEST, 5e-324)
    if cell is not None:
        return min(top, max(least, 2.0 ** math.ceil(math.log2(cell)))), least
    side, n = top, stats["n"]
    while side > least and (top / side) ** 2 < n / cell_boxes:
        s = side / 2
        if not stats["wh"] / s / s + 2.0 * stats["wph"] / s + 4.0 * n <= (COPIES + 4.0) * n:
            break
        side = s
    return side, least


def _index(v, side: float):
    return F.floor(F.col(v) / F.lit(side))


def _into_cells(boxes: DataFrame, side: float, within: bool) -> DataFrame:
    """``cx, cy`` and the clipped boxes, one row per cell a box touches;
    ``within``: only cells inside the (8 times larger) cell the row names."""
    low, high = [_index(c, side) for c in BOUNDS[:2]], [_index(c, side) for c in BOUNDS[2:]]
    if within:
        low = [F.greatest(v, F.col(c) * SPLIT) for v, c in zip(low, CELL)]
        high = [F.least(v, F.col(c) * SPLIT + SPLIT - 1) for v, c in zip(high, CELL)]
    out = boxes.select(*BOUNDS, F.explode(F.sequence(low[0], high[0])).alias("cx"), low[1].alias("y0"), high[1].alias("y1"))
    out = out.select(*BOUNDS, "cx", F.explode(F.sequence("y0", "y1")).alias("cy"))
    clipped = [F.when(_index(lo, side) < F.col(c), (F.col(c) - 1) * F.lit(side)).otherwise(F.col(lo)).alias(lo) for lo, c in zip(BOUNDS[:2], CELL)]
    clipped += [F.when(_index(hi, side) > F.col(c), (F.col(c) + 2) * F.lit(side)).otherwise(F.col(hi)).alias(hi) for hi, c in zip(BOUNDS[2:], CELL)]
    return out.select(*CELL, *clipped).distinct()


def _sorted_cells(cells: DataFrame, side: float, cell_boxes: int) -> DataFrame:
    """``crowded`` for every row, without the rows of cells that one box covers."""
    over = F.lit(True)
    for lo, hi, c in zip(BOUNDS[:2], BOUNDS[2:], CELL):
        over = over & (_index(lo, side) < F.col(c)) & (_index(hi, side) > F.col(c))
    state = cells.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"), F.max(over).alias("covered"))
    state = state.where(~F.col("covered")).select(*(F.col(c).alias(f"k{c}") for c in CELL), (F.col("n") > cell_boxes).alias("crowded"))
    met = (F.col("cx") == F.col("kcx")) & (F.col("cy") == F.col("kcy"))
    # the hint: Spark underestimates rows behind an explode and would send a table of all cells through the driver
    return cells.join(state.hint("merge"), met).select(*CELL, *BOUNDS, "crowded")


def cell_vertices(boxes: np.ndarray, left: float, bottom: float, side: float) -> np.ndarray:
    """Vertices in the half-open cell of the union of boxes (rows of bounds)
    that, outside the cell, may reach anywhere."""
    strips = []
    for lo, hi, at in ((boxes[:, 0], boxes[:, 2], left), (boxes[:, 1], boxes[:, 3], bottom)):
        cuts = np.unique(np.concatenate([lo, hi]))
        cuts = cuts[(cuts >= at) & (cuts < at + side)]
        # strip i lies between cuts i - 1 and i
        strips.append((cuts, np.searchsorted(cuts, lo, side="right"), np.searchsorted(cuts, hi, side="left") + 1))
    (xs, x0, x1), (ys, y0, y1) = strips
    marks = np.zeros((len(xs) + 2, len(ys) + 2), np.int32)
    for i, j, sign in ((x0, y0, 1), (x1, y1, 1), (x0, y1, -1), (x1, y0, -1)):
        np.add.at(marks, (i, j), sign)
    covered = marks.cumsum(axis=0).cumsum(axis=1)[:-1, :-1] > 0
    sw, se, nw, ne = covered[:-1, :-1], covered[1:, :-1], covered[:-1, 1:], covered[1:, 1:]
    count = sw.astype(np.int8) + se + nw + ne
    i, j = np.nonzero((count == 1) | (count == 3) | ((count == 2) & (ne == sw)))
    return np.stack([xs[i], ys[j]], axis=1)


def _solve(side: float):
    """The vertices of one group: a cell's boxes."""
    def solve(key: tuple, group: pa.Table) -> pa.Table:
        boxes = np.stack([group.column(c).to_numpy() for c in BOUNDS], axis=1)
        found = cell_vertices(boxes, key[0].as_py() * side, key[1].as_py() * side, side)
        return pa.table({"x": found[:, 0], "y": found[:, 1]})
    return solve


def union_vertices(boxes: DataFrame, x1="x1", y1="y1", x2="x2", y2="y2", *, cell: float | None = None,
                   broadcast_limit: int | None = None, cell_boxes: int = CELL_BOXES) -> DataFrame:
    """Distinct vertices ``(x, y)`` of the union of the boxes.

    ``cell`` sets the start side (rounded up to a power of two), ``cell_boxes``
    how many boxes a cell may hold before it is cut.  ``broadcast_limit`` is
    accepted for older callers; nothing is broadcast.
    """
    w, h = F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")
    b, stats = materialize_with_stats(
        prepare_boxes(boxes, x1, y1, x2, y2), F.count(F.lit(1)).alias("n"), F.min(F.least("xmin", "ymin")).alias("lo"),
        F.max(F.greatest("xmax", "ymax")).alias("hi"), F.sum(w * h).alias("wh"), F.sum(w + h).alias("wph"))
    if not stats["n"]:
        return b.select(F.col("xmin").alias("x"), F.col("ymin").alias("y"))
    side, least = start_side(stats, cell_boxes, cell)
    cells, solved = _into_cells(b, side, within=False), []
    while True:
        cells, left = materialize_with_stats(_sorted_cells(materialize(cells), side, cell_boxes), F.max("crowded").alias("crowded"))
        last = not left["crowded"] or side <= least
        done = cells if last else cells.where(~F.col("crowded"))
        solved.append(done.groupBy(*CELL).applyInArrow(_solve(side), "x double, y double"))
        if last:
            break
        side /= SPLIT
        cells = _into_cells(cells.where("crowded"), side, within=True)
    out = solved[0]
    for more in solved[1:]:
        out = out.unionByName(more)
    return out
