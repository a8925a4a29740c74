"""Property tests (hypothesis) on small integer layouts against brute force.

Integer coordinates make touching edges, shared corners, nesting, copies
and zero-area boxes common, which is where the exact rules matter.
"""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quadrille.operators.box_union import union_vertices
from quadrille.operators.spatial_join import spatial_join_lines
from tests import brute

coord = st.integers(min_value=0, max_value=8).map(float)
box = st.tuples(coord, coord, coord, coord)
SETTINGS = settings(max_examples=12, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(boxes=st.lists(box, min_size=0, max_size=14),
       cell=st.sampled_from([None, 0.7, 2.0, 5.0]))
def test_union_vertices_property(spark, boxes, cell):
    df = spark.createDataFrame(boxes, "x1 double, y1 double, x2 double, y2 double")
    got = sorted((r.x, r.y) for r in union_vertices(df, cell=cell).collect())
    assert got == brute.union_vertices(boxes)


@SETTINGS
@given(rects=st.lists(box, min_size=0, max_size=8), probes=st.lists(box, min_size=1, max_size=12),
       cell=st.sampled_from([None, 0.5, 3.0]))
def test_join_lines_property(spark, rects, probes, cell):
    r = spark.createDataFrame([(f"r{i}", *b) for i, b in enumerate(rects)],
                              "id string, x1 double, y1 double, x2 double, y2 double")
    p_rows = [(f"p{i % 4}", *b) for i, b in enumerate(probes)]
    p = spark.createDataFrame(p_rows, "id string, x1 double, y1 double, x2 double, y2 double")
    got = sorted(x.line for x in spatial_join_lines(p, r, cell=cell).collect())
    assert got == brute.join_lines(p_rows, [(f"r{i}", *b) for i, b in enumerate(rects)])


point = st.tuples(st.integers(min_value=0, max_value=6).map(float), st.integers(min_value=0, max_value=6).map(float))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(points=st.lists(point, min_size=0, max_size=25), cap_limit=st.sampled_from([3, 10 ** 6]))
def test_hull_and_pairs_property(spark, points, cap_limit):
    from quadrille.operators.closest_pair import closest_pair
    from quadrille.operators.hull import convex_hull, farthest_pair
    df = spark.createDataFrame(points, "x double, y double")
    hull = [(r.x, r.y) for r in sorted(convex_hull(df, cap_limit=cap_limit).collect(), key=lambda r: r.seq)]
    assert hull == brute.hull_vertices(points)
    far = [(r.x1, r.y1, r.x2, r.y2, r.d2) for r in farthest_pair(df, cap_limit=cap_limit).collect()]
    assert far == ([brute.farthest(points)] if points else [])
    near = [(r.x1, r.y1, r.x2, r.y2, r.d2) for r in closest_pair(df).collect()]
    exp = brute.closest(points)
    assert near == ([exp] if exp else [])
