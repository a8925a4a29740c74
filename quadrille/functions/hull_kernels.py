"""Per-batch kernels run inside ``mapInPandas`` / ``applyInPandas``.

Small numpy helpers only; Spark partitions and shuffles the work around
them.  The module is pickled by value so executors need no install of the
package.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd

try:  # ship these functions by value to the Python workers
    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(sys.modules[__name__])
except Exception:  # pragma: no cover
    pass


ROUNDS = 64  # vectorised passes before the rest is left to the stack


def _turns_left(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each point but the ends: whether the path turns left there."""
    return (x[1:-1] - x[:-2]) * (y[2:] - y[:-2]) - (y[1:-1] - y[:-2]) * (x[2:] - x[:-2]) > 0


def _lower_chain(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strict lower chain of distinct points sorted along it.

    A point that does not lie strictly below the segment between its neighbours
    is no vertex, whatever becomes of these, so all such points go at once; a
    path that turns left everywhere is the chain.  What is left after ``ROUNDS``
    passes (an unusual shape) goes through a stack.
    """
    for _ in range(ROUNDS):
        if len(x) < 3:
            return x, y
        kept = np.ones(len(x), bool)
        kept[1:-1] = _turns_left(x, y)
        if kept.all():
            return x, y
        x, y = x[kept], y[kept]
    hx, hy = [], []
    for px, py in zip(x.tolist(), y.tolist()):
        while len(hx) >= 2 and (hx[-1] - hx[-2]) * (py - hy[-2]) - (hy[-1] - hy[-2]) * (px - hx[-2]) <= 0:
            hx.pop()
            hy.pop()
        hx.append(px)
        hy.append(py)
    return np.asarray(hx), np.asarray(hy)


def monotone_chain(xs: np.ndarray, ys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strict convex hull, counter-clockwise, open, starting at min (x, y).

    Duplicate and collinear points are dropped.  One distinct point gives that
    point, two give both.
    """
    if len(xs) == 0:
        return xs[:0], ys[:0]
    order = np.lexsort((ys, xs))
    x, y = np.asarray(xs, float)[order], np.asarray(ys, float)[order]
    fresh = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))
    x, y = x[fresh], y[fresh]
    if len(x) <= 2:
        return x, y
    lx, ly = _lower_chain(x, y)
    ux, uy = _lower_chain(x[::-1], y[::-1])
    return np.concatenate([lx[:-1], ux[:-1]]), np.concatenate([ly[:-1], uy[:-1]])


def _d2(ax, ay, bx, by):
    dx = ax - bx
    dy = ay - by
    return dx * dx + dy * dy


def antipodal_candidates(hx: np.ndarray, hy: np.ndarray) -> list[tuple[int, int]]:
    """Index pairs covering every antipodal pair of a strict CCW hull.

    Rotating calipers: for each edge the farthest vertex by triangle area
    is tracked; a window of neighbours around the caliper is reported too,
    so rounding in the area comparison never loses a pair.
    """
    h = len(hx)
    if h <= 3:
        return [(i, j) for i in range(h) for j in range(i, h)]
    x = hx.tolist()
    y = hy.tolist()

    def area(i, j, k):
        return abs((x[j] - x[i]) * (y[k] - y[i]) - (y[j] - y[i]) * (x[k] - x[i]))

    out = []
    j = 1
    for i in range(h):
        i2 = (i + 1) % h
        steps = 0
        while steps < h and area(i, i2, (j + 1) % h) >= area(i, i2, j):
            j = (j + 1) % h
            steps += 1
        for k in (-2, -1, 0, 1, 2):
            jj = (j + k) % h
            out.append((i, jj))
            out.append((i2, jj))
    return out


def farthest_from_hull(hx: np.ndarray, hy: np.ndarray):
    """Farthest pair ``(x1, y1, x2, y2, d2)`` with ``(x1,y1) <= (x2,y2)``;
    ties broken by the smallest ``(x1, y1, x2, y2)``."""
    if len(hx) == 0:
        return None
    best = None
    for i, j in antipodal_candidates(hx, hy):
        a = (float(hx[i]), float(hy[i]))
        b = (float(hx[j]), float(hy[j]))
        if b < a:
            a, b = b, a
        d2 = _d2(a[0], a[1], b[0], b[1])
        key = (-d2, a[0], a[1], b[0], b[1])
        if best is None or key < best:
            best = key
    d2, x1, y1, x2, y2 = -best[0], best[1], best[2], best[3], best[4]
    return x1, y1, x2, y2, d2


def _cross(o, a, b) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def outer_chain(xs: np.ndarray, ys: np.ndarray, a, b) -> list[tuple[float, float]]:
    """Hull vertices strictly beyond the directed edge ``a -> b`` of a CCW
    polygon, in counter-clockwise order, followed by ``b``.

    The hull of the cap points plus ``a`` and ``b`` runs a -> (outer chain)
    -> b -> (anything on the inner side) -> a counter-clockwise, so the
    outer vertices form one contiguous run.
    """
    hx, hy = monotone_chain(np.concatenate([xs, [a[0], b[0]]]), np.concatenate([ys, [a[1], b[1]]]))
    pts = list(zip(hx.tolist(), hy.tolist()))
    out = [_cross(a, b, p) < 0 for p in pts]
    n = len(pts)
    chain = []
    if any(out):
        start = next(k for k in range(n) if out[k] and not out[k - 1]) if not all(out) else 0
        k = start
        while out[k] and len(chain) < n:
            chain.append(pts[k])
            k = (k + 1) % n
    return chain + [(float(b[0]), float(b[1]))]


def make_cap_chain(poly: list[tuple[float, float]]):
    """``applyInPandas`` over cap groups: the hull chain beyond edge ``cap``
    of the CCW polygon ``poly``, as ``cap, pos, n, x, y`` (pos from 1, n the
    chain length; the chain ends at the edge's end vertex)."""
    m = len(poly)

    def cap_chain(pdf: pd.DataFrame) -> pd.DataFrame:
        i = int(pdf["cap"].iloc[0])
        chain = outer_chain(pdf["x"].to_numpy(float), pdf["y"].to_numpy(float), poly[i], poly[(i + 1) % m])
        n = len(chain)
        return pd.DataFrame({"cap": np.full(n, i, dtype=np.int64),
                             "pos": np.arange(1, n + 1, dtype=np.int64),
                             "n": np.full(n, n, dtype=np.int64),
                             "x": [p[0] for p in chain], "y": [p[1] for p in chain]})
    return cap_chain


def group_farthest(pdf: pd.DataFrame) -> pd.DataFrame:
    """``applyInPandas``: farthest pair among the group's points (their hull
    plus rotating calipers), as one ``x1, y1, x2, y2, d2`` row."""
    hx, hy = monotone_chain(pdf["x"].to_numpy(float), pdf["y"].to_numpy(float))
    res = farthest_from_hull(hx, hy)
    cols = ["x1", "y1", "x2", "y2", "d2"]
    if res is None:
        return pd.DataFrame({c: pd.Series([], dtype=float) for c in cols})
    return pd.DataFrame([res], columns=cols)


def drop_flat_junctions(caps: list[dict]) -> set[int]:
    """Caps whose end vertex (the junction with the next chain) is not a
    strict hull vertex.

    ``caps[i]`` holds ``n`` (chain length), ``first`` (pos 1), ``penult``
    (pos n-1) and ``last`` (the junction).  Only a junction's neighbours
    matter, so a short cyclic list of first / penultimate / junction
    vertices is enough; flat junctions are dropped until none is left.
    """
    seq = []  # (point, cap index if it is a junction else None)
    for i, c in enumerate(caps):
        if c["n"] >= 2:
            seq.append((c["first"], None))
        if c["n"] >= 3:
            seq.append((c["penult"], None))
        if c["n"] >= 1:
            seq.append((c["last"], i))
    alive = [True] * len(seq)
    dropped: set[int] = set()
    changed = len(seq) >= 3
    while changed:
        changed = False
        for k, (pt, cap) in enumerate(seq):
            if cap is None or not alive[k]:
                continue
            prev = next(seq[(k - d) % len(seq)][0] for d in range(1, len(seq)) if alive[(k - d) % len(seq)])
            nxt = next(seq[(k + d) % len(seq)][0] for d in range(1, len(seq)) if alive[(k + d) % len(seq)])
            if sum(alive) > 3 and _cross(prev, pt, nxt) <= 0:
                alive[k] = False
                dropped.add(cap)
                changed = True
    return dropped
