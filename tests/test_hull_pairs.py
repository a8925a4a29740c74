import math
import random

import pytest

from quadrille.operators.closest_pair import closest_pair
from quadrille.operators.hull import convex_hull, farthest_pair
from tests import brute

PTS = "x double, y double"
NAN, INF = math.nan, math.inf


def hull_rows(df):
    return [(r.x, r.y) for r in sorted(df.collect(), key=lambda r: r.seq)]


def pair_row(df):
    rows = df.collect()
    assert len(rows) <= 1
    if not rows:
        return None
    r = rows[0]
    assert r.dist == pytest.approx(math.sqrt(r.d2))
    return (r.x1, r.y1, r.x2, r.y2, r.d2)


def test_square_with_midpoints_and_duplicates(spark):
    pts = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (1.0, 0.0), (2.0, 1.0), (1.0, 2.0),
           (0.0, 1.0), (1.0, 1.0), (0.0, 0.0), (2.0, 2.0), (NAN, 5.0), (None, 1.0), (INF, 0.0)]
    df = spark.createDataFrame(pts, PTS)
    assert hull_rows(convex_hull(df)) == [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0)]
    assert pair_row(farthest_pair(df)) == (0.0, 0.0, 2.0, 2.0, 8.0)
    assert pair_row(closest_pair(df)) == (0.0, 0.0, 0.0, 1.0, 1.0)


@pytest.mark.parametrize("pts,hull,far,near", [
    ([], [], None, None),
    ([(1.0, 2.0)], [(1.0, 2.0)], (1.0, 2.0, 1.0, 2.0, 0.0), None),
    ([(1.0, 2.0)] * 4, [(1.0, 2.0)], (1.0, 2.0, 1.0, 2.0, 0.0), None),
    ([(3.0, 1.0), (1.0, 2.0)], [(1.0, 2.0), (3.0, 1.0)], (1.0, 2.0, 3.0, 1.0, 5.0), (1.0, 2.0, 3.0, 1.0, 5.0)),
    ([(float(i), 2.0 * i) for i in range(6)], [(0.0, 0.0), (5.0, 10.0)], (0.0, 0.0, 5.0, 10.0, 125.0),
     (0.0, 0.0, 1.0, 2.0, 5.0)),
])
def test_degenerate_inputs(spark, pts, hull, far, near):
    df = spark.createDataFrame(pts, PTS)
    assert hull_rows(convex_hull(df)) == hull
    assert pair_row(farthest_pair(df)) == far
    assert pair_row(closest_pair(df)) == near


def _rand_points(rng, n, kind):
    if kind == "grid":  # many ties and collinear points
        return [(float(rng.randint(0, 12)), float(rng.randint(0, 12))) for _ in range(n)]
    if kind == "circle":  # every point on the hull
        out = []
        for i in range(n):
            t = 2 * math.pi * i / n
            out.append((round(1000 * math.cos(t), 6), round(1000 * math.sin(t), 6)))
        return out
    if kind == "cluster":  # a third of the points in one tight cluster
        out = [(rng.uniform(-100, 100), rng.uniform(-100, 100)) for _ in range(2 * n // 3)]
        out += [(5 + rng.uniform(0, 1e-3), 5 + rng.uniform(0, 1e-3)) for _ in range(n // 3)]
        return out
    return [(rng.uniform(-1, 1), rng.uniform(-1, 1)) for _ in range(n)]


@pytest.mark.parametrize("seed,kind,n,parts", [
    (1, "uniform", 300, 1), (2, "grid", 300, 7), (3, "circle", 120, 5), (4, "cluster", 300, 4),
    (5, "grid", 60, 40)])
def test_random_vs_brute(spark, seed, kind, n, parts):
    rng = random.Random(seed)
    pts = _rand_points(rng, n, kind)
    df = spark.createDataFrame(pts, PTS).repartition(parts)
    for limit in (10 ** 6, 8):  # whole caps; split caps
        assert hull_rows(convex_hull(df, cap_limit=limit)) == brute.hull_vertices(pts)
        assert pair_row(farthest_pair(df, cap_limit=limit)) == brute.farthest(pts)
    assert pair_row(closest_pair(df)) == brute.closest(pts)


def test_closest_pair_with_heavy_copies(spark):
    # one point repeated many times plus a loose spread: copies collapse,
    # the answer is over distinct points
    pts = [(0.5, 0.5)] * 3000 + [(float(i), float(i * i % 17)) for i in range(200)] + [(0.5, 0.5000001)]
    df = spark.createDataFrame(pts, PTS).repartition(6)
    assert pair_row(closest_pair(df)) == brute.closest(pts)


def clockwise(hx, hy):
    ccw = list(zip(hx.tolist(), hy.tolist()))
    return ccw[:1] + ccw[1:][::-1]


@pytest.mark.parametrize("kind,cap_limit", [("circle", 200_000), ("parabola", 200_000),
                                            ("square_edges", 200_000), ("circle", 40),
                                            ("parabola", 25), ("diagonal", 30)])
def test_large_hulls_split_into_caps(spark, kind, cap_limit):
    import numpy as np
    from quadrille.functions import hull_kernels as K
    from quadrille.operators.hull import CapHull
    rng = random.Random(11)
    if kind == "circle":
        pts = [(round(1e4 * math.cos(t), 3), round(1e4 * math.sin(t), 3))
               for t in (rng.uniform(0, 2 * math.pi) for _ in range(4000))]
    elif kind == "parabola":
        pts = [(float(v), float(v * v)) for v in range(-1500, 1500)] + [(0.0, 3e6)]
    elif kind == "diagonal":  # many collinear points on a slanted hull edge
        pts = [(float(i), float(1000 - i)) for i in range(1000)] + [(0.0, 0.0), (300.0, 200.0)]
        pts += [(rng.uniform(0, 600), rng.uniform(0, 300)) for _ in range(500)]
    else:  # many collinear points on each edge, plus interior points
        pts = [(float(i), 0.0) for i in range(500)] + [(float(i), 499.0) for i in range(500)]
        pts += [(0.0, float(i)) for i in range(500)] + [(499.0, float(i)) for i in range(500)]
        pts += [(rng.uniform(1, 498), rng.uniform(1, 498)) for _ in range(2000)]
    df = spark.createDataFrame(pts, PTS).repartition(8)
    arr = np.asarray(sorted(set(pts)), dtype=float)
    hx, hy = K.monotone_chain(arr[:, 0], arr[:, 1])
    expected = clockwise(hx, hy)
    caps = CapHull(df, "x", "y", cap_limit)
    assert len(caps.poly) >= 3
    sizes = [r["count"] for r in caps.grouped.groupBy("cap").count().collect()]
    assert max(sizes) <= cap_limit + 1  # points of one group, plus its end vertex
    assert hull_rows(convex_hull(df, cap_limit=cap_limit)) == expected
    hull = expected
    best = None
    for i, a in enumerate(hull):
        for b in hull[i:]:
            a2, b2 = min(a, b), max(a, b)
            key = (-brute.d2(a2, b2), a2, b2)
            best = key if best is None or key < best else best
    assert pair_row(farthest_pair(df, cap_limit=cap_limit)) == (best[1][0], best[1][1], best[2][0], best[2][1], -best[0])


def expected_hull(pts):
    import numpy as np
    from quadrille.functions import hull_kernels as K
    arr = np.asarray(sorted(set(pts)), dtype=float)
    return clockwise(*K.monotone_chain(arr[:, 0], arr[:, 1]))


def expected_farthest(hull):
    best = min((-brute.d2(min(a, b), max(a, b)), min(a, b), max(a, b)) for i, a in enumerate(hull) for b in hull[i:])
    return (*best[1], *best[2], -best[0])


def ellipse(n, long, short, degrees):
    t0 = math.radians(degrees)
    out = []
    for k in range(n):
        t = 2 * math.pi * k / n
        x, y = long * math.cos(t), short * math.sin(t)
        out.append((x * math.cos(t0) - y * math.sin(t0), x * math.sin(t0) + y * math.cos(t0)))
    return out


@pytest.mark.parametrize("long,short,degrees", [(1000, 1, 50), (1000, 1, 0), (1e6, 1e-2, 33)])
def test_thin_shapes_take_the_cap_plan(spark, long, short, degrees):
    from quadrille.operators.hull import CapHull
    pts = ellipse(3000, long, short, degrees) + [(0.0, 0.0)]
    df = spark.createDataFrame(pts, PTS).repartition(6)
    caps = CapHull(df, "x", "y", 100)
    assert len(caps.poly) >= 3
    assert max(r["count"] for r in caps.grouped.groupBy("cap").count().collect()) <= 101
    assert hull_rows(convex_hull(df, cap_limit=100)) == expected_hull(pts)
    assert pair_row(farthest_pair(df, cap_limit=100)) == expected_farthest(expected_hull(pts))


def test_points_on_one_line(spark):
    pts = [(float(i), float(2 * i + 1)) for i in range(-50, 300)] * 2
    df = spark.createDataFrame(pts, PTS).repartition(5)
    assert hull_rows(convex_hull(df)) == [(-50.0, -99.0), (299.0, 599.0)]
    assert pair_row(farthest_pair(df))[:4] == (-50.0, -99.0, 299.0, 599.0)


@pytest.mark.parametrize("kind", ["circle", "parabola", "uneven"])
def test_every_direction_lies_in_a_chain_range(spark, kind):
    from quadrille.operators.hull import CapHull
    for seed in range(3):
        rng = random.Random(seed)
        if kind == "circle":
            pts = [(math.cos(t), math.sin(t)) for t in (rng.uniform(0, 2 * math.pi) for _ in range(900))]
        elif kind == "parabola":
            pts = [(float(v), float(v * v)) for v in rng.sample(range(-5000, 5000), 900)] + [(0.0, 3e7)]
        else:  # most points in a narrow arc
            pts = [(math.cos(t), math.sin(t)) for t in (2 * math.pi * rng.random() ** 6 for _ in range(900))]
        caps = CapHull(spark.createDataFrame(pts, PTS).repartition(4), "x", "y", 12)
        m, turn = len(caps.poly), 2 * math.pi
        spans = [(caps.rng[i][0], (caps.rng[(i + 1) % m][1] - caps.rng[i][0]) % turn) for i in range(m)]
        assert all(length < math.pi for _, length in spans)
        for k in range(3600):
            t = turn * k / 3600
            assert any((t - start) % turn <= length + 1e-9 or (t - start) % turn >= turn - 1e-9 for start, length in spans), (seed, t)
        assert pair_row(caps.farthest()) == expected_farthest(expected_hull(pts))


def test_farthest_pair_on_many_seeds(spark):
    from pyspark.sql import functions as F
    for seed in range(50):
        rng = random.Random(seed)
        n, wide = rng.randint(3, 60), rng.choice([1, 3, 50, 1000])
        pts = [(float(rng.randint(-wide, wide)), float(rng.randint(-wide, wide))) for _ in range(n)]
        df = spark.createDataFrame(pts, PTS).coalesce(2)
        assert pair_row(farthest_pair(df, cap_limit=rng.choice([3, 10 ** 6]))) == brute.farthest(pts), seed


def test_closest_pair_on_a_lattice_with_far_points(spark):
    """Lattice points share no small cell: the bound must still come down."""
    import pandas as pd
    from pyspark.sql import functions as F
    from quadrille.operators import closest_pair as CP
    from quadrille.plans.session import materialize_with_stats
    pts = [(float(i), float(j)) for i in range(200) for j in range(200)] + [(1e4, 1e4), (-1e4, 0.0)]
    df = spark.createDataFrame(pd.DataFrame(pts, columns=["x", "y"])).repartition(8)
    p, st = materialize_with_stats(df, F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"),
                                   F.min("y").alias("y0"), F.max("y").alias("y1"))
    g = CP.distance_bound(p, st)
    assert CP._cells(p, g).groupBy("_cx", "_cy").count().agg(F.max("count")).first()[0] <= CP.K_MAX
    assert pair_row(closest_pair(df)) == (0.0, 0.0, 0.0, 1.0, 1.0)


def test_closest_pair_hot_cluster_vs_sorted_sweep(spark):
    # a third of the points in one tight cluster: the bound rounds must
    # shrink the grid there; checked against an exact sorted sweep
    import numpy as np
    import pandas as pd
    from quadrille.operators import closest_pair as CP
    rng = np.random.default_rng(3)
    pts = np.vstack([rng.uniform(-1e3, 1e3, size=(20_000, 2)),
                     7.0 + rng.uniform(0, 1e-3, size=(10_000, 2))]).round(9)
    df = spark.createDataFrame(pd.DataFrame(pts, columns=["x", "y"])).repartition(8)
    seen = []
    orig = CP._fine_round

    def traced(p, size):
        out = orig(p, size)
        seen.append(out[1])
        return out
    CP._fine_round = traced
    try:
        row = pair_row(closest_pair(df))
    finally:
        CP._fine_round = orig
    u = np.unique(pts, axis=0)
    u = u[np.lexsort((u[:, 1], u[:, 0]))]
    bound, best, k = math.sqrt(row[4]) * 1.000001, math.inf, 1
    while k < len(u):
        dx = u[k:, 0] - u[:-k, 0]
        if (dx > bound).all():
            break
        m = dx <= bound
        dd = dx[m] ** 2 + (u[k:, 1] - u[:-k, 1])[m] ** 2
        best = min(best, dd.min()) if dd.size else best
        k += 1
    assert row[4] == best
    assert len(seen) <= 6 and seen[-1] <= 64  # a few rounds; cells end small


def _stack_chain(points):
    pts = sorted(set(points))
    if len(pts) <= 2:
        return pts

    def half(path):
        out = []
        for x, y in path:
            while len(out) >= 2 and (out[-1][0] - out[-2][0]) * (y - out[-2][1]) - (out[-1][1] - out[-2][1]) * (x - out[-2][0]) <= 0:
                out.pop()
            out.append((x, y))
        return out

    return half(pts)[:-1] + half(pts[::-1])[:-1]


@pytest.mark.parametrize("rounds", [0, 1, 64])
def test_chain_kernel_against_a_stack(monkeypatch, rounds):
    import numpy as np

    from quadrille.functions import hull_kernels as K
    monkeypatch.setattr(K, "ROUNDS", rounds)
    rng = random.Random(7)
    for k in range(600):
        side = rng.randint(1, 12)
        points = [(float(rng.randint(0, side)), float(rng.randint(0, side))) if k % 3 else (rng.random(), rng.random()) for _ in range(rng.randint(1, 60))]
        hx, hy = K.monotone_chain(*(np.array(c) for c in zip(*points)))
        assert list(zip(hx.tolist(), hy.tolist())) == _stack_chain(points)


def test_closest_pair_copies_only_points_near_borders(spark):
    from quadrille.operators.closest_pair import with_border_copies
    rng = random.Random(9)
    pts = spark.createDataFrame([(rng.random(), rng.random()) for _ in range(5000)], "x double, y double")
    assert with_border_copies(pts, 0.002, 1.0).count() < 1.5 * 5000


def test_opposite_ranges_are_those_of_all_pairs():
    import numpy as np
    from quadrille.operators.hull import opposite_ranges
    rng = np.random.default_rng(3)
    for m in (3, 4, 7, 40, 300):
        cuts = np.sort(rng.uniform(-np.pi, np.pi, 2 * m))
        first, last = cuts[0::2], cuts[1::2]  # directions of each vertex
        first, last = np.roll(first, -(m // 3)), np.roll(last, -(m // 3))
        length = (np.roll(last, -1) - first) % (2 * np.pi)
        opp = (first + np.pi) % (2 * np.pi)
        meets = (((first[None] - opp[:, None]) % (2 * np.pi) <= length[:, None])
                 | ((opp[:, None] - first[None]) % (2 * np.pi) <= length[None]))
        assert opposite_ranges(first, length) == [(i, j) for i in range(m) for j in range(i, m) if meets[i, j]]


def test_plan_does_not_grow_with_the_caps(spark):
    import math
    from quadrille.operators.hull import CapHull
    pts = [(math.cos(2 * math.pi * k / 900) * 1e6, math.sin(2 * math.pi * k / 900) * 1e6) for k in range(900)]
    df = spark.createDataFrame(pts, "x double, y double")
    lengths, caps = [], []
    for limit in (200, 4):
        caps.append(len((hull := CapHull(df, "x", "y", limit)).poly))
        text = spark._jvm.PythonSQLUtils.explainString(hull.farthest()._jdf.queryExecution(), "simple")
        lengths.append(len(text))
    assert caps[1] > 1.5 * caps[0] and lengths[1] <= 1.1 * lengths[0]
