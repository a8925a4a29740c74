"""Column expressions for planar geometry.

Everything here returns a ``pyspark.sql.Column`` built from built-in
functions, so it stays inside whole-stage codegen and, where the operands
are plain columns and literals, can be pushed down to the Parquet scan.

Conventions
-----------
* A *raw box* has corner columns ``x1, y1, x2, y2`` in any order.
* A *normalised box* has ``xmin, ymin, xmax, ymax``.
* Spark orders NaN above every number (``NaN = NaN`` is true), unlike Java
  where every comparison with NaN is false.  ``is_finite`` / ``is_number``
  are the guards used at operator boundaries so NaN never matches.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_number(c: str | Column) -> Column:
    """Not NULL and not NaN (infinities allowed)."""
    c = col(c)
    return c.isNotNull() & ~F.isnan(c)


def is_finite(c: str | Column) -> Column:
    """Not NULL, not NaN, not infinite.

    ``c > -inf AND c < inf`` is false for NaN in Spark (NaN sorts above
    +inf) and NULL for NULL, so the plain comparison form is enough and is
    pushable to Parquet.
    """
    c = col(c)
    return (c > F.lit(-INF)) & (c < F.lit(INF))


def all_of(conds: list[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


def normalized_bounds(x1="x1", y1="y1", x2="x2", y2="y2") -> list[Column]:
    """``[xmin, ymin, xmax, ymax]`` aliased columns from two raw corners."""
    return [
        F.least(col(x1), col(x2)).alias("xmin"),
        F.least(col(y1), col(y2)).alias("ymin"),
        F.greatest(col(x1), col(x2)).alias("xmax"),
        F.greatest(col(y1), col(y2)).alias("ymax"),
    ]


def inside_window_inclusive(window: tuple[float, float, float, float],
                            x1="x1", y1="y1", x2="x2", y2="y2") -> Column:
    """Both raw corners inside the (normalised) window, edges included.

    Written as four ``BETWEEN``s on plain columns so every bound is pushed
    to the Parquet reader; equivalent to ``min corner >= window min and
    max corner <= window max``.  NaN never satisfies ``<= finite``.
    """
    wx0, wy0, wx1, wy1 = window
    return all_of([
        col(x1).between(wx0, wx1), col(x2).between(wx0, wx1),
        col(y1).between(wy0, wy1), col(y2).between(wy0, wy1),
    ])


def strictly_inside(px: Column, py: Column, xmin: Column, ymin: Column,
                    xmax: Column, ymax: Column) -> Column:
    """Point strictly inside the open box (touching an edge is outside)."""
    return (xmin < px) & (px < xmax) & (ymin < py) & (py < ymax)


def squared_distance(ax: Column, ay: Column, bx: Column, by_: Column) -> Column:
    """``dx*dx + dy*dy`` (same operand order everywhere, so every engine
    rounds alike)."""
    dx = ax - bx
    dy = ay - by_
    return dx * dx + dy * dy


def point_lt(ax: Column, ay: Column, bx: Column, by_: Column) -> Column:
    """Lexicographic ``(ax, ay) < (bx, by)``."""
    return (ax < bx) | ((ax == bx) & (ay < by_))
