"""O3: window (range) query over boxes.

Keeps a box when both of its raw corners lie inside the window, edges
included.  The window is normalised on the driver (constant folding), and
the predicate is four ``BETWEEN``s on the plain corner columns, so Catalyst
pushes every bound into the Parquet scan (``PushedFilters``) and row groups
whose min/max statistics miss the window are skipped.  No shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions.geometry import inside_window_inclusive


def normalize_window(window) -> tuple[float, float, float, float]:
    """``(x1, y1, x2, y2)`` in any corner order -> ``(xmin, ymin, xmax, ymax)``."""
    if len(window) != 4:
        raise ValueError("window must be (x1, y1, x2, y2)")
    x1, y1, x2, y2 = (float(v) for v in window)
    if any(math.isnan(v) for v in (x1, y1, x2, y2)):
        raise ValueError("window bounds must not be NaN")
    return (min(x1, x2), min(y1, y2), max(x1, x2), max(y1, y2))


def range_query(boxes: DataFrame, window, x1: str = "x1", y1: str = "y1",
                x2: str = "x2", y2: str = "y2") -> DataFrame:
    """Rows of ``boxes`` fully inside ``window`` (inclusive), columns unchanged."""
    w = normalize_window(window)
    return boxes.where(inside_window_inclusive(w, x1, y1, x2, y2))


def range_query_lines(result: DataFrame, id_col: str = "id") -> DataFrame:
    """Text form ``ID: <id>  Coordinates:  x1, y1;   x2,  y2`` (one column ``line``)."""
    s = lambda c: F.col(c).cast("string")
    return result.select(F.concat(
        F.lit("ID: "), s(id_col), F.lit("  Coordinates:  "), s("x1"), F.lit(", "), s("y1"),
        F.lit(";   "), s("x2"), F.lit(",  "), s("y2")).alias("line"))
