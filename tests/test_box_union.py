import math
import random

import pytest

from quadrille.operators.box_union import union_vertices
from tests import brute

BOX = "x1 double, y1 double, x2 double, y2 double"


def verts(spark, boxes, **kw):
    df = spark.createDataFrame(boxes, BOX)
    return sorted((r.x, r.y) for r in union_vertices(df, **kw).collect())


@pytest.mark.parametrize("boxes,expected", [
    # shared edge: one 2x1 rectangle
    ([(0, 0, 1, 1), (1, 0, 2, 1)], [(0, 0), (0, 1), (2, 0), (2, 1)]),
    # corners touching diagonally: the touch point is a vertex once
    ([(0, 0, 1, 1), (1, 1, 2, 2)], [(0, 0), (0, 1), (1, 0), (1, 1), (1, 2), (2, 1), (2, 2)]),
    # nested box: only the outer corners
    ([(0, 0, 4, 4), (1, 1, 2, 2)], [(0, 0), (0, 4), (4, 0), (4, 4)]),
    # zero-area and swapped-corner boxes
    ([(3, 3, 3, 5), (1, 1, 0, 0)], [(0, 0), (0, 1), (1, 0), (1, 1)]),
    # ring with a hole: outer and inner corners
    ([(0, 0, 3, 1), (0, 2, 3, 3), (0, 1, 1, 2), (2, 1, 3, 2)],
     [(0, 0), (0, 3), (1, 1), (1, 2), (2, 1), (2, 2), (3, 0), (3, 3)]),
    # plus sign: crossings become reflex vertices
    ([(0, 1, 3, 2), (1, 0, 2, 3)],
     [(0, 1), (0, 2), (1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (2, 1), (2, 2), (2, 3), (3, 1), (3, 2)]),
    ([], []),
])
def test_hand_cases(spark, boxes, expected):
    fb = [tuple(float(v) for v in b) for b in boxes]
    assert verts(spark, fb) == [tuple(float(v) for v in e) for e in expected]
    assert brute.union_vertices(fb) == [tuple(float(v) for v in e) for e in expected]


def test_nan_and_infinite_boxes_ignored(spark):
    boxes = [(0.0, 0.0, 1.0, 1.0), (math.nan, 0.0, 1.0, 1.0), (0.0, 0.0, math.inf, 2.0), (None, 0.0, 1.0, 1.0)]
    assert verts(spark, boxes) == [(0.0, 0.0), (0.0, 1.0), (1.0, 0.0), (1.0, 1.0)]


def _rand_boxes(rng, n, wide):
    out = []
    for _ in range(n):
        x, y = rng.randint(0, 30), rng.randint(0, 30)
        w = rng.choice([0, 1, 2, 3, 5]) if not wide else rng.choice([1, 2, 40, 300])
        h = rng.choice([0, 1, 2, 4]) if not wide else rng.choice([1, 3, 25, 200])
        if rng.random() < 0.5:
            out.append((float(x + w), float(y), float(x), float(y + h)))
        else:
            out.append((float(x), float(y), float(x + w), float(y + h)))
    return out + out[:3]


@pytest.mark.parametrize("seed,n,wide,cell,limit", [
    (1, 80, False, None, None), (2, 120, False, 0.6, 0), (3, 60, True, None, None), (4, 60, True, 0.5, 0),
    (5, 150, False, 7.0, None), (6, 60, True, 0.5, None)])
def test_random_vs_brute(spark, seed, n, wide, cell, limit):
    rng = random.Random(seed)
    boxes = _rand_boxes(rng, n, wide)
    if limit == 0:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        expected = brute.union_vertices(boxes)
        assert verts(spark, boxes, cell=cell, broadcast_limit=limit) == expected
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("seed,cell", [(7, None), (8, 0.9), (9, 2.5),
                                       (10, None), (11, 1.3)])
def test_heavy_overlap_vs_brute(spark, seed, cell):
    rng = random.Random(seed)
    boxes = []
    for _ in range(70):  # big boxes overlapping one another over a shared core
        x0, y0 = rng.randint(0, 20), rng.randint(0, 20)
        boxes.append((float(x0), float(y0), float(x0 + rng.randint(15, 40)), float(y0 + rng.randint(15, 40))))
    for _ in range(60):  # small boxes, many nested inside the big ones
        x0, y0 = rng.randint(0, 60), rng.randint(0, 60)
        boxes.append((float(x0), float(y0), float(x0 + rng.randint(1, 3)), float(y0 + rng.randint(1, 3))))
    assert verts(spark, boxes, cell=cell) == brute.union_vertices(boxes)


def test_regions_covered_by_many_boxes_together(spark):
    """5,000 boxes tile a square; none covers a cell alone, and nothing inside is emitted."""
    n, boxes = 50, []
    for i in range(n):
        for j in range(n):  # two overlapping halves a tile
            boxes.append((float(i), float(j), i + 0.75, j + 1.0))
            boxes.append((i + 0.5, float(j), i + 1.0, j + 1.0))
    assert verts(spark, boxes, cell_boxes=16) == [(0.0, 0.0), (0.0, n), (n, 0.0), (n, n)]


def test_boxes_crowded_in_one_corner(spark):
    """Nested boxes that share a corner, and tiny ones in a far smaller corner, are cut apart."""
    rng = random.Random(3)
    boxes = [(0.0, 0.0, 1.0 + i, 1.0 + rng.random() * 500) for i in range(200)]
    boxes += [(-1.0 - rng.random() / 1e6, -1.0, -1.0, -1.0 + rng.random() / 1e6) for _ in range(100)]
    assert verts(spark, boxes, cell_boxes=8) == brute.union_vertices(boxes)


def test_no_box_is_joined_with_another(spark):
    rng = random.Random(2)
    df = spark.createDataFrame(_rand_boxes(rng, 50, False), BOX)
    plan = union_vertices(df)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
