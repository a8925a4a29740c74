"""O6 convex hull and O7 farthest pair.

Plan
----
1. Keep finite points only (NULL/NaN/infinite coordinates are dropped).
   The points are materialised: several passes read them.
2. One pass takes the extreme point in each of 32 directions (every task its
   best per direction, over Arrow batches; an aggregate leaves one row each).
   Their polygon P lies inside the hull, so points strictly inside it
   (with a relative rounding margin) cannot be hull vertices; that filter
   is plain column arithmetic in whole-stage codegen.
3. Exact reductions on what is left: for each distinct ``y`` only the
   min-x and max-x points can be strict vertices, then the same per ``x``
   (partial aggregation collapses heavy rows of equal coordinates).
4. Each survivor lies beyond exactly one edge of P (beyond two adjacent
   edges it would out-project their shared extreme point), so the hull is
   the concatenation of independent chains, one per edge: the survivors
   are grouped by edge (``applyInPandas``, monotone chain per group).  A
   cap with more than ``CAP_LIMIT`` points is split at further hull
   vertices (its extreme points in sub-directions; the chain inside a cap
   is monotone along the edge) until every group is under the limit.  The
   chains are checkpointed; flat junctions between chains, chain lengths
   and ``seq`` offsets are a few values per cap on the driver.  ``seq``
   numbers the hull clockwise from its smallest ``(x, y)``.
5. Farthest pair: both ends of a farthest pair are hull vertices with
   opposite normals, so each chain is paired only with the chains whose
   direction range is opposite; rotating calipers run inside each pair
   group and a distributed top-1 picks the answer.  No group ever holds
   the whole hull and no pair table is built.

Every input takes this plan.  If the 32 directions meet only two extreme
points (a thin shape), the directions are taken anew in coordinates in which
the shape is as wide as it is long.  If all points lie on one line the hull is
its two ends, found by ``min`` and ``max``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions import hull_kernels as K
from quadrille.functions.geometry import is_finite
from quadrille.plans.session import materialize, materialize_with_stats

CAP_DIRECTIONS = 32
# Points per cap group above which a cap is split further (see
# CapHull._split_big_caps), and sub-directions sampled per split.
CAP_LIMIT = 200_000
SUB_DIRECTIONS = 16
REL_MARGIN = 1e-12

HULL_SCHEMA = "seq long, x double, y double"
PAIR_SCHEMA = "x1 double, y1 double, x2 double, y2 double, d2 double, dist double"
PAIR_SCHEMA_COLS = ("x1", "y1", "x2", "y2", "d2", "dist")


def finite_points(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    return (points.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
                  .where(is_finite("x") & is_finite("y")))


def drop_inside(pts: DataFrame, poly: list[tuple[float, float]]) -> DataFrame:
    """Remove points strictly inside the CCW polygon (with a rounding margin)."""
    if len(poly) < 3:
        return pts
    inside = None
    for i, (ax, ay) in enumerate(poly):
        bx, by = poly[(i + 1) % len(poly)]
        t1 = F.lit(bx - ax) * (F.col("y") - F.lit(ay))
        t2 = F.lit(by - ay) * (F.col("x") - F.lit(ax))
        edge = (t1 - t2) > F.lit(REL_MARGIN) * (F.abs(t1) + F.abs(t2))
        inside = edge if inside is None else inside & edge
    return pts.where(~inside)


def _row_extremes(pts: DataFrame, key: str, other: str) -> DataFrame:
    g = pts.groupBy(key).agg(F.min(other).alias("_lo"), F.max(other).alias("_hi"))
    ends = F.array_distinct(F.array(F.col("_lo"), F.col("_hi")))
    return g.select(F.col(key), F.explode(ends).alias(other)).select("x", "y")


def _uniform_directions(n: int) -> list[tuple[float, float]]:
    return [(math.cos(2 * math.pi * k / n), math.sin(2 * math.pi * k / n)) for k in range(n)]


def _stretched_directions(a, b, width: float, n: int) -> list[tuple[float, float]]:
    """``n`` directions spread evenly for a shape of length ``|b - a|`` along
    ``a -> b`` and of ``width`` across (counter-clockwise from ``a -> b``)."""
    ux, uy = b[0] - a[0], b[1] - a[1]
    length = math.hypot(ux, uy)
    ux, uy = ux / length, uy / length
    out = []
    for k in range(n):
        t = 2 * math.pi * k / n
        along, across = math.cos(t) * width / length, math.sin(t)
        scale = math.hypot(along, across)
        along, across = along / scale, across / scale
        out.append((ux * along - uy * across, uy * along + ux * across))
    return out


def _extremes(pts: DataFrame, directions: list[tuple[float, float]]):
    """The extreme point per direction (ties to the largest ``(x, y)``), the
    smallest ``(x, y)`` point, which is always a hull vertex, and the number
    of points; ``(None, None, 0)`` without points.

    One pass: every task keeps its best point per direction over Arrow batches
    and emits one row each, which an aggregate reduces to one row a direction.
    """
    dx, dy = (np.array(c)[:, None] for c in zip(*directions))

    def best_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}
        n = 0
        for batch in batches:
            x, y = (batch.column(c).to_numpy() for c in ("x", "y"))
            if not len(x):
                continue
            n += len(x)
            values = dx * x + dy * y
            top = values.max(axis=1)
            for k, at in enumerate(values.argmax(axis=1)):
                if k in best and top[k] < best[k][0]:
                    continue
                same = np.flatnonzero(values[k] == top[k])
                at = same[np.lexsort((y[same], x[same]))[-1]]
                best[k] = max(best.get(k, (-np.inf,)), (top[k], x[at], x[at], y[at]))
            low = np.flatnonzero(x == x.min())
            at = low[y[low].argmin()]
            best[-1] = max(best.get(-1, (-np.inf,)), (-x[at], -y[at], x[at], y[at]))
        rows = np.array([[k, *v, n * (k < 0)] for k, v in best.items()], float).reshape(-1, 6)
        yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0].astype(np.int64)), *[pa.array(rows[:, j]) for j in range(1, 5)], pa.array(rows[:, 5].astype(np.int64))],
                                         names=["k", "v", "w", "x", "y", "n"])

    found = pts.select("x", "y").mapInArrow(best_of, "k long, v double, w double, x double, y double, n long")
    found = {int(r["k"]): r for r in found.groupBy("k").agg(F.max(F.struct("v", "w", "x", "y")).alias("p"), F.sum("n").alias("n")).collect()}
    if not found:
        return None, None, 0
    point = {k: (float(r["p"]["x"]), float(r["p"]["y"])) for k, r in found.items()}
    return [point[k] for k in range(len(directions))], point[-1], int(found[-1]["n"])


def _polygon(points) -> list[tuple[float, float]]:
    arr = np.asarray(sorted(set(points)), dtype=float).reshape(-1, 2)
    hx, hy = K.monotone_chain(arr[:, 0], arr[:, 1])
    return list(zip(hx.tolist(), hy.tolist()))


def _cap_index(poly: list[tuple[float, float]]):
    """Column ``struct(d, i)``: the edge ``i`` of the CCW polygon a point lies
    farthest beyond, and that distance ``d``."""
    m = len(poly)
    items = []
    for i, (ax, ay) in enumerate(poly):
        bx, by = poly[(i + 1) % m]
        length = math.hypot(bx - ax, by - ay)
        beyond = -(F.lit(bx - ax) * (F.col("y") - F.lit(ay))
                   - F.lit(by - ay) * (F.col("x") - F.lit(ax))) / F.lit(length)
        items.append(F.struct(beyond.alias("d"), F.lit(i).cast("long").alias("i")))
    return F.array_max(F.array(*items))


# Rows of a table of caps that are broadcast (at most a few hundred bytes each).
CAPS_BROADCAST = 100_000


def join_caps(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """``df`` with what is known of its caps (``cap`` and further columns), rows of other caps left out.

    A table beside the plan, so that the plan is as long however many caps there are.
    """
    caps = df.sparkSession.createDataFrame(rows, schema)
    return df.join(F.broadcast(caps) if len(rows) <= CAPS_BROADCAST else caps, "cap")


def opposite_ranges(first: np.ndarray, length: np.ndarray, margin: float = 1e-9) -> list[tuple[int, int]]:
    """Pairs ``i <= j`` of direction ranges ``[first, first + length]`` (radians) of which one
    turned by pi meets the other.  The ranges follow each other counter-clockwise in starts and ends, so
    those that meet a range stand in a row: two binary searches a range, not all against all."""
    turn = 2 * math.pi
    step = np.diff(first) % turn
    step[step > turn - margin] = 0.0  # a step back by rounding
    start = first[0] + np.concatenate([[0.0], np.cumsum(step)])
    end = np.maximum.accumulate(start + length + margin)
    start = start - margin
    starts, ends = (np.concatenate([v + k * turn for k in range(-2, 3)]) for v in (start, end))
    ends = np.maximum.accumulate(ends)
    m, pairs = len(first), set()
    lo = np.searchsorted(ends, start + math.pi, "left")
    hi = np.searchsorted(starts, end + math.pi, "right")
    for i in range(m):
        pairs.update((min(i, j), max(i, j)) for j in {int(k) % m for k in range(lo[i], hi[i])})
    return sorted(pairs)


class CapHull:
    """Hull split into chains, one per edge of the extreme-point polygon.

    Every point that can be a hull vertex lies beyond exactly one edge of
    the polygon spanned by the extreme points (beyond two adjacent edges it
    would out-project the shared extreme point), so the hull is the
    concatenation of independent per-edge chains: one ``applyInPandas``
    group per edge, never one group for the whole hull.  Junction checks,
    per-chain counts and offsets involve at most ``CAP_DIRECTIONS`` values.
    """

    def __init__(self, points: DataFrame, x: str, y: str, cap_limit: int = CAP_LIMIT):
        # read by several passes: columns computed by the caller are evaluated once
        pts = materialize(finite_points(points, x, y))
        self.pts = pts
        self.cap_limit = cap_limit
        self.poly: list[tuple[float, float]] = []
        self.line: list[tuple[float, float]] = []  # the hull if it has at most two points
        self.directions = _uniform_directions(CAP_DIRECTIONS)
        self.ext, self.low, n = _extremes(pts, self.directions)
        if not n:
            return
        self.poly = _polygon(self.ext)
        if len(self.poly) == 2:
            self._stretch()
        if len(self.poly) < 3:
            ends = pts.agg(F.min(F.struct("x", "y")).alias("a"), F.max(F.struct("x", "y")).alias("b")).first()
            self.line = sorted({(float(e["x"]), float(e["y"])) for e in ends})
            return
        self._build()

    def _stretch(self) -> None:
        """Take the directions anew for a thin shape between two extremes."""
        a, b = self.poly
        across = (F.lit(b[0] - a[0]) * (F.col("y") - F.lit(a[1])) - F.lit(b[1] - a[1]) * (F.col("x") - F.lit(a[0])))
        ends = self.pts.agg(F.min(across).alias("lo"), F.max(across).alias("hi")).first()
        width = (ends["hi"] - ends["lo"]) / math.hypot(b[0] - a[0], b[1] - a[1])
        if not width > 0:
            return
        self.directions = _stretched_directions(a, b, width, CAP_DIRECTIONS)
        self.ext, self.low, _ = _extremes(self.pts, self.directions)
        self.poly = _polygon(self.ext)

    def _direction_ranges(self) -> list[tuple[float, float]]:
        """Per polygon vertex, the first and last sampled direction (radians,
        counter-clockwise) in which it is the extreme point."""
        d = len(self.directions)
        angles = [math.atan2(dy, dx) for dx, dy in self.directions]
        out = []
        for v in self.poly:
            own = {k for k in range(d) if self.ext[k] == v}
            first = next(k for k in own if (k - 1) % d not in own) if len(own) < d else 0
            last = next(k for k in own if (k + 1) % d not in own) if len(own) < d else d - 1
            out.append((angles[first], angles[first] + (angles[last] - angles[first]) % (2 * math.pi)))
        return out

    def _build(self) -> None:
        poly = self.poly
        cand = _row_extremes(_row_extremes(drop_inside(self.pts, poly), "y", "x"), "x", "y")
        # keep points strictly beyond their edge: points on an edge of the
        # polygon (collinear) are never strict vertices
        cur = (cand.select(_cap_index(poly).alias("c"), "x", "y").where(F.col("c.d") > 0)
                   .select(F.col("c.i").alias("cap"), "x", "y"))
        cur = materialize(cur)  # read by every split round and by the chains
        cur, poly, rng = self._split_big_caps(cur, poly, self._direction_ranges())
        self.poly, self.rng = poly, rng
        m = len(poly)
        spark = self.pts.sparkSession
        ends = spark.createDataFrame([(i, poly[(i + 1) % m][0], poly[(i + 1) % m][1]) for i in range(m)],
                                     "cap long, x double, y double")
        grouped = cur.unionByName(ends)
        self.grouped = grouped
        lx, ly = self.low
        # each chain's first, penultimate and end rows, plus the row of the
        # smallest point (at most 3 per cap + 1), observed in the same job
        # that checkpoints the chains
        edge = ((F.col("pos") == 1) | (F.col("pos") >= F.col("n") - 1)
                | ((F.col("x") == lx) & (F.col("y") == ly)))
        self.chains, seen = materialize_with_stats(
            grouped.groupBy("cap").applyInPandas(K.make_cap_chain(poly),
                                                 "cap long, pos long, n long, x double, y double"),
            F.collect_list(F.when(edge, F.struct("cap", "pos", "n", "x", "y"))).alias("rows"))
        edge_rows = seen["rows"]
        caps = [{"n": 0, "first": None, "penult": None, "last": None} for _ in range(m)]
        low_at = None
        for r in edge_rows:
            c, pos, pt = caps[int(r["cap"])], int(r["pos"]), (float(r["x"]), float(r["y"]))
            c["n"] = int(r["n"])
            if pos == 1:
                c["first"] = pt
            if pos == c["n"] - 1:
                c["penult"] = pt
            if pos == c["n"]:
                c["last"] = pt
            if pt == self.low and (low_at is None or pos < c["n"]):
                low_at = (int(r["cap"]), pos)
        n_of = [c["n"] for c in caps]
        dropped = K.drop_flat_junctions(caps)
        kept = [n_of[i] - (1 if i in dropped else 0) for i in range(m)]
        offsets = np.concatenate([[0], np.cumsum(kept)[:-1]]).astype(int).tolist()
        self.h = int(sum(kept))
        placed = join_caps(self.chains, [(i, offsets[i], i in dropped) for i in range(m)], "cap long, offset long, flat boolean")
        self.vertices = placed.where(~((F.col("pos") == F.col("n")) & F.col("flat"))).drop("flat")
        self.low_g = offsets[low_at[0]] + low_at[1] - 1
        self.n_of, self.dropped = n_of, dropped

    def _split_big_caps(self, cur: DataFrame, poly: list, rng: list) -> tuple[DataFrame, list]:
        """Split every cap holding more than ``cap_limit`` points.

        Within the cap of edge ``a -> b`` the hull chain is monotone along
        ``a -> b`` (its normals stay between the directions in which ``a``
        and ``b`` are extreme; a point projecting before ``a`` would
        out-project ``a``).  The cap's extreme points in sub-directions of
        that range are therefore hull vertices that cut the chain into
        independent pieces; points go to the piece whose projection
        interval holds them, and only points strictly beyond their new edge
        stay.  Two aggregates per round, only over the oversized caps.
        """
        sub = SUB_DIRECTIONS
        while True:  # every round cuts each big cap at a new hull vertex
            big = sorted(int(r["cap"]) for r in cur.groupBy("cap").count()
                         .where(F.col("count") > self.cap_limit).collect())
            if not big:
                break
            m = len(poly)
            angles = {}
            for i in big:
                (ax, ay), (bx, by) = poly[i], poly[(i + 1) % m]
                start = rng[i][1]
                span = (rng[(i + 1) % m][0] - start) % (2 * math.pi)
                # every angle is start + an offset in [0, span], so that the
                # smallest and largest of a vertex bound its directions
                normal = (math.atan2(-(bx - ax), by - ay) - start) % (2 * math.pi)
                if normal > span:  # rounding at an end of the range
                    normal = span if normal - span < 2 * math.pi - normal else 0.0
                angles[i] = [start + span * j / (sub + 1) for j in range(1, sub + 1)] + [start + normal]
            turned = [(i, [math.cos(t) for t in angles[i]], [math.sin(t) for t in angles[i]]) for i in big]
            projs = [F.col("x") * F.col("cx")[j] + F.col("y") * F.col("cy")[j] for j in range(sub + 1)]
            inside = join_caps(cur, turned, "cap long, cx array<double>, cy array<double>")
            maxima = inside.groupBy("cap").agg(F.array(*[F.max(p) for p in projs]).alias("tops")).collect()
            inside = join_caps(inside, [(int(r["cap"]), list(r["tops"])) for r in maxima], "cap long, tops array<double>")
            eqs = [p == F.col("tops")[j] for j, p in enumerate(projs)]
            hit = eqs[0]
            for e in eqs[1:]:
                hit = hit | e
            found = inside.where(hit).groupBy("cap").agg(
                *[F.max(F.when(e, F.struct("x", "y"))).alias(f"v{j}") for j, e in enumerate(eqs)]).collect()
            new_vertices: dict[int, dict] = {}
            for r in found:
                i = int(r["cap"])
                a, b = poly[i], poly[(i + 1) % m]
                for j in range(sub + 1):
                    v = r[f"v{j}"]
                    if v is None:
                        continue
                    pt = (float(v["x"]), float(v["y"]))
                    if pt in (a, b) or K._cross(a, b, pt) >= 0:
                        continue
                    lo, hi = new_vertices.get(i, {}).get(pt, (angles[i][j], angles[i][j]))
                    new_vertices.setdefault(i, {})[pt] = (min(lo, angles[i][j]), max(hi, angles[i][j]))
            if not new_vertices:  # the farthest point of a cap beyond its edge is one
                raise ArithmeticError(f"caps {big} hold over {self.cap_limit} points and no point beyond their edges")
            new_poly, new_rng, first_id, bounds = [], [], [], []
            for i in range(m):
                first_id.append(len(new_poly))
                new_poly.append(poly[i])
                new_rng.append(rng[i])
                a, b = poly[i], poly[(i + 1) % m]
                ux, uy = b[0] - a[0], b[1] - a[1]
                ins = sorted(new_vertices.get(i, {}).items(),
                             key=lambda kv: (kv[0][0] - a[0]) * ux + (kv[0][1] - a[1]) * uy)
                bounds.append([(pt[0] - a[0]) * ux + (pt[1] - a[1]) * uy for pt, _ in ins])
                for pt, r_ in ins:
                    new_poly.append(pt)
                    new_rng.append(r_)
            mm = len(new_poly)
            pieces = [(i, first_id[i], *poly[i], poly[(i + 1) % m][0] - poly[i][0], poly[(i + 1) % m][1] - poly[i][1], bounds[i]) for i in range(m)]
            staged = join_caps(cur, pieces, "cap long, first long, ax double, ay double, ux double, uy double, bounds array<double>")
            t = (F.col("x") - F.col("ax")) * F.col("ux") + (F.col("y") - F.col("ay")) * F.col("uy")
            new_cap = F.col("first") + F.size(F.filter("bounds", lambda v: v < t))
            staged = staged.select(new_cap.alias("cap"), "x", "y")
            edges = [(i, *new_poly[i], *new_poly[(i + 1) % mm]) for i in range(mm)]
            staged = join_caps(staged, edges, "cap long, vx double, vy double, wx double, wy double")
            beyond = -((F.col("wx") - F.col("vx")) * (F.col("y") - F.col("vy"))
                       - (F.col("wy") - F.col("vy")) * (F.col("x") - F.col("vx")))
            staged = staged.where(beyond > 0).select("cap", "x", "y")
            cur = materialize(staged)
            poly, rng = new_poly, new_rng
        return cur, poly, rng

    def hull(self) -> DataFrame:
        """``seq, x, y`` clockwise from the smallest ``(x, y)``."""
        g = F.col("offset") + F.col("pos") - 1
        seq = F.pmod(F.lit(int(self.low_g)) - g, F.lit(self.h))
        return self.vertices.select(seq.cast("long").alias("seq"), "x", "y")

    def antipodal_pairs(self) -> list[tuple[int, int]]:
        """Pairs ``(i, j)``, ``i <= j``, of caps that may hold a farthest pair.

        Cap ``i`` (edge ``v_i -> v_i+1``) holds every hull vertex whose
        normal cone meets ``[first(v_i), last(v_i+1)]``, the directions from
        where its start vertex begins to be extreme to where its end vertex
        stops; both ends of a farthest pair have opposite normals, so caps
        are paired when one range turned by pi meets the other (with a small
        angular margin).
        """
        m = len(self.poly)
        first = np.array([self.rng[i][0] for i in range(m)])
        length = np.array([(self.rng[(i + 1) % m][1] - self.rng[i][0]) % (2 * math.pi) for i in range(m)])
        return opposite_ranges(first, length)

    def farthest(self) -> DataFrame:
        m = len(self.poly)
        pairs = self.antipodal_pairs()
        member = [(c, p) for p, (i, j) in enumerate(pairs) for c in {i, j}]
        v = self.vertices.select("cap", "pos", "n", "x", "y")
        # each chain also carries its start vertex (the previous chain's end)
        starts = (v.where(F.col("pos") == F.col("n"))
                   .select(F.pmod(F.col("cap") + 1, F.lit(m)).alias("cap"), "pos", "n", "x", "y"))
        rows = join_caps(v.unionByName(starts), member, "cap long, pair long").select("pair", "x", "y")
        best = rows.groupBy("pair").applyInPandas(K.group_farthest,
                                                  "x1 double, y1 double, x2 double, y2 double, d2 double")
        top = best.orderBy(F.col("d2").desc(), "x1", "y1", "x2", "y2").limit(1)
        return top.withColumn("dist", F.sqrt("d2"))


def convex_hull(points: DataFrame, x: str = "x", y: str = "y", cap_limit: int = CAP_LIMIT) -> DataFrame:
    """Strict hull vertices ``(seq, x, y)``, clockwise from the smallest (x, y).

    Collinear and duplicate points are not vertices; one distinct point
    gives one row; no points give no rows.
    """
    caps = CapHull(points, x, y, cap_limit)
    if caps.poly and not caps.line:
        return caps.hull()
    rows = [(i, *p) for i, p in enumerate(caps.line)]
    return points.sparkSession.createDataFrame(rows, HULL_SCHEMA)


def farthest_pair(points: DataFrame, x: str = "x", y: str = "y", cap_limit: int = CAP_LIMIT) -> DataFrame:
    """One row ``(x1, y1, x2, y2, d2, dist)``: the two points farthest apart.

    ``(x1, y1) <= (x2, y2)``; ties go to the smallest ``(x1, y1, x2, y2)``;
    a single distinct point gives ``(p, p, 0, 0)``; no points, no row.
    Both ends of a farthest pair are hull vertices with opposite normals, so
    only antipodal chains are paired (rotating calipers inside each pair).
    """
    caps = CapHull(points, x, y, cap_limit)
    if caps.poly and not caps.line:
        return caps.farthest().select(*PAIR_SCHEMA_COLS)
    rows = []
    if caps.line:
        (x1, y1), (x2, y2) = caps.line[0], caps.line[-1]
        d2 = (x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)
        rows = [(x1, y1, x2, y2, d2, math.sqrt(d2))]
    return points.sparkSession.createDataFrame(rows, PAIR_SCHEMA)
