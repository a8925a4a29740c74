import math

import pytest

from quadrille.operators.range_query import normalize_window, range_query, range_query_lines

SCHEMA = "id string, x1 double, y1 double, x2 double, y2 double"
NAN, INF = math.nan, math.inf


def ids(df):
    return sorted(r.id for r in df.collect())


def test_inclusive_edges_and_corner_order(spark):
    rows = [("eq", 0.0, 0.0, 1.0, 1.0),          # equal to the window
            ("edge", 1.0, 0.5, 0.5, 1.0),        # corner on the edge, swapped
            ("in", 0.2, 0.2, 0.3, 0.3),
            ("out", 0.5, 0.5, 1.0000001, 0.6),
            ("nan", NAN, 0.2, 0.3, 0.3),
            ("null", None, 0.2, 0.3, 0.3),
            ("inf", 0.1, 0.1, INF, 0.2)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert ids(range_query(df, (1, 1, 0, 0))) == ["edge", "eq", "in"]
    assert ids(range_query(df, (0, 0, INF, 1))) == ["edge", "eq", "in", "inf", "out"]


def test_window_validation():
    assert normalize_window((3, 4, 1, 2)) == (1.0, 2.0, 3.0, 4.0)
    with pytest.raises(ValueError):
        normalize_window((0, NAN, 1, 1))
    with pytest.raises(ValueError):
        normalize_window((0, 1))


def test_filters_reach_parquet_scan(spark, tmp_out):
    df = spark.createDataFrame([("a", 0.1, 0.1, 0.2, 0.2)], SCHEMA)
    df.write.parquet(f"{tmp_out}/b")
    q = range_query(spark.read.parquet(f"{tmp_out}/b"), (-1, -1, 1, 1))
    plan = spark._jvm.PythonSQLUtils.explainString(q._jdf.queryExecution(), "formatted")
    pushed = [ln for ln in plan.splitlines() if "PushedFilters" in ln][0]
    for c in ("x1", "x2", "y1", "y2"):
        assert f"GreaterThanOrEqual({c},-1.0)" in pushed and f"LessThanOrEqual({c},1.0)" in pushed
    assert "Exchange" not in plan


def test_text_form(spark):
    df = spark.createDataFrame([("7", 1.0, 2.0, 3.0, 4.0)], SCHEMA)
    assert range_query_lines(df).first().line == "ID: 7  Coordinates:  1.0, 2.0;   3.0,  4.0"
