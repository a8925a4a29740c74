"""Independent brute-force answers for small inputs (pure Python)."""

from __future__ import annotations

import itertools
import math


def finite(*vs):
    return all(v is not None and math.isfinite(v) for v in vs)


def _contained(p, r):
    _, a, b, c, d = p
    _, r1, r2, r3, r4 = r
    vals = (r1, r2, r3, r4, a, b, c, d)
    if any(v is None or (isinstance(v, float) and math.isnan(v)) for v in vals):
        return None
    xmin, xmax, ymin, ymax = min(r1, r3), max(r1, r3), min(r2, r4), max(r2, r4)
    if xmin < a < xmax and xmin < c < xmax and ymin < b < ymax and ymin < d < ymax:
        return (r[0], xmin, ymin, xmax, ymax)
    return None


def containment_matches(pairs, rects):
    """Per probe index, the list of normalised matching rects."""
    return [[m for m in (_contained(p, r) for r in rects) if m] for p in pairs]


def containment_pairs(pairs, rects):
    """pairs: (id, x1, y1, x2, y2); rects: (id, x1, y1, x2, y2) raw corners."""
    return [(p, m) for p, ms in zip(pairs, containment_matches(pairs, rects)) for m in ms]


def join_lines(pairs, rects):
    lines = []
    for p, ms in zip(pairs, containment_matches(pairs, rects)):
        hits = sorted((m[1], m[0]) for m in ms)
        lines.append(f"{p[0]}: " + ",".join(h[1] for h in hits))
    return sorted(lines)


def _cross(o, a, b):
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def hull_vertices(points):
    """Strict hull vertices by the edge test, clockwise from min (x, y)."""
    pts = sorted({p for p in points if finite(*p)})
    if len(pts) <= 2:
        return pts
    verts = set()
    for p in pts:
        for q in pts:
            if p == q:
                continue
            ok = True
            for r in pts:
                c = _cross(p, q, r)
                if c < 0:
                    ok = False
                    break
                if c == 0:
                    if ((r[0] - p[0]) * (q[0] - p[0]) + (r[1] - p[1]) * (q[1] - p[1]) < 0
                            or (r[0] - q[0]) * (p[0] - q[0]) + (r[1] - q[1]) * (p[1] - q[1]) < 0):
                        ok = False
                        break
            if ok:
                verts.add(p)
                break
    v0 = min(verts)
    rest = sorted((v for v in verts if v != v0),
                  key=lambda v: -math.atan2(v[1] - v0[1], v[0] - v0[0]))
    return [v0] + rest


def d2(a, b):
    dx = a[0] - b[0]
    dy = a[1] - b[1]
    return dx * dx + dy * dy


def farthest(points):
    pts = sorted({p for p in points if finite(*p)})
    if not pts:
        return None
    best = None
    for i, a in enumerate(pts):
        for b in pts[i:]:
            key = (-d2(a, b), a, b)
            if best is None or key < best:
                best = key
    return (best[1][0], best[1][1], best[2][0], best[2][1], -best[0])


def closest(points):
    pts = sorted({p for p in points if finite(*p)})
    if len(pts) < 2:
        return None
    best = None
    for a, b in itertools.combinations(pts, 2):
        key = (d2(a, b), a, b)
        if best is None or key < best:
            best = key
    return (best[1][0], best[1][1], best[2][0], best[2][1], best[0])


def union_vertices(boxes):
    """Coordinate compression: covered elementary cells, then the vertex
    rule on the grid points between them.  boxes: raw (x1, y1, x2, y2)."""
    bs = set()
    for x1, y1, x2, y2 in boxes:
        if not finite(x1, y1, x2, y2):
            continue
        a, b, c, d = min(x1, x2), min(y1, y2), max(x1, x2), max(y1, y2)
        if a < c and b < d:
            bs.add((a, b, c, d))
    if not bs:
        return []
    xs = sorted({v for b in bs for v in (b[0], b[2])})
    ys = sorted({v for b in bs for v in (b[1], b[3])})
    xi = {v: i for i, v in enumerate(xs)}
    yi = {v: i for i, v in enumerate(ys)}
    cov = [[False] * (len(ys) - 1) for _ in range(len(xs) - 1)]
    for a, b, c, d in bs:
        for i in range(xi[a], xi[c]):
            for j in range(yi[b], yi[d]):
                cov[i][j] = True

    def cell(i, j):
        if 0 <= i < len(xs) - 1 and 0 <= j < len(ys) - 1:
            return cov[i][j]
        return False

    out = []
    for i, x in enumerate(xs):
        for j, y in enumerate(ys):
            ne, nw, se, sw = cell(i, j), cell(i - 1, j), cell(i, j - 1), cell(i - 1, j - 1)
            s = ne + nw + se + sw
            if s in (1, 3) or (s == 2 and ne == sw):
                out.append((x, y))
    return sorted(out)
