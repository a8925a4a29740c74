import math

import pytest

from quadrille.sources.readers import normalize_boxes, read_boxes, read_points
from quadrille.sources.ingest import ingest
from quadrille.sources.sinks import box_csv_lines, pair_lines, point_lines, write_result


def _write(tmp_out, name, lines):
    p = f"{tmp_out}/{name}"
    with open(p, "w") as f:
        f.write("\n".join(lines) + "\n")
    return p


def test_points_layout_and_padding(spark, tmp_out):
    p = _write(tmp_out, "pts.csv", ["0,a,1.5,2", "0, b , 3 , -4.25 ,extra", "x,,NaN,Infinity"])
    rows = read_points(spark, p).collect()
    got = {r.id: (r.x, r.y) for r in rows}
    assert got["a"] == (1.5, 2.0)
    assert got["b"] == (3.0, -4.25)
    assert math.isnan(got[""][0]) and got[""][1] == math.inf


@pytest.mark.parametrize("bad", ["0,a,1.5", "id,name,x,y", "0,a,1.5,abc", ""])
def test_bad_line_fails(spark, tmp_out, bad):
    # a blank line in the middle is a malformed (short) line too
    p = _write(tmp_out, "bad.csv", ["0,a,1,2", bad, "0,c,3,4"])
    with pytest.raises(Exception) as e:
        read_points(spark, p).collect()
    assert "malformed line" in str(e.value)


def test_bad_lines_dropped(spark, tmp_out):
    p = _write(tmp_out, "bad.csv", ["0,a,1,2", "0,a,1.5", "h,id,x,y", "", "0,c,3,4"])
    rows = read_points(spark, p, on_bad="drop").collect()
    assert sorted((r.id, r.x, r.y) for r in rows) == [("a", 1.0, 2.0), ("c", 3.0, 4.0)]


def test_boxes_layout_and_normalize(spark, tmp_out):
    p = _write(tmp_out, "boxes.csv", ["0, r1 ,3,4,1,2", "0,r2,0,0,1,1,zz"])
    raw = read_boxes(spark, p)
    assert sorted(tuple(r) for r in raw.collect()) == [("r1", 3.0, 4.0, 1.0, 2.0), ("r2", 0.0, 0.0, 1.0, 1.0)]
    n = {r.id: tuple(r)[1:] for r in normalize_boxes(raw).collect()}
    assert n["r1"] == (1.0, 2.0, 3.0, 4.0)
    with pytest.raises(Exception):
        read_boxes(spark, _write(tmp_out, "short.csv", ["0,r1,3,4,1"])).collect()


def test_parquet_sources(spark, tmp_out):
    df = spark.createDataFrame([(1, 1.0, 2.0)], "vid long, px double, py double")
    df.write.parquet(f"{tmp_out}/p")
    pts = read_points(spark, f"{tmp_out}/p", fmt="parquet", columns={"id": "vid", "x": "px", "y": "py"})
    assert pts.collect()[0].asDict() == {"id": "1", "x": 1.0, "y": 2.0}


def test_ingest_round_trip_sorted(spark, tmp_out):
    lines = [f"0,r{i},{(i * 7) % 11},{i},{(i * 7) % 11 + 1.5},{i + 2}" for i in range(40)]
    src = _write(tmp_out, "layer.csv", lines)
    t = ingest(spark, src, f"{tmp_out}/table", "boxes", partitions=3)
    assert t.count() == 40
    assert sorted(r.id for r in t.collect()) == sorted(f"r{i}" for i in range(40))
    # files are range partitioned and sorted on x1
    xs = [r.x1 for r in spark.read.parquet(f"{tmp_out}/table").collect()]
    assert sorted(xs) == sorted(r.x1 for r in t.collect())


def test_ingest_bad_line_modes(spark, tmp_out):
    src = _write(tmp_out, "layer.csv", ["0,a,1,2", "oops"])
    with pytest.raises(Exception):
        ingest(spark, src, f"{tmp_out}/t1", "points")
    assert ingest(spark, src, f"{tmp_out}/t2", "points", on_bad="drop").count() == 1


def test_sinks_text_forms(spark, tmp_out):
    pts = spark.createDataFrame([(1.0, 2.5), (10000000.0, -0.5)], "x double, y double")
    assert sorted(r.line for r in point_lines(pts, ", ").collect()) == ["1.0, 2.5", "1.0E7, -0.5"]
    pair = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, 8.0, 2.8)], "x1 double, y1 double, x2 double, y2 double, d2 double, dist double")
    assert [r.line for r in pair_lines(pair, ",  ").collect()] == ["1.0,  2.0", "3.0,  4.0"]
    out = write_result(point_lines(pts, ",  ", order_by="x"), f"{tmp_out}/hull", "text", single_file=True)
    files = [f for f in __import__("os").listdir(out) if f.startswith("part-")]
    assert len(files) == 1
    with pytest.raises(ValueError):
        write_result(pts, f"{tmp_out}/bad", "text")


def test_box_csv_round_trip_exact(spark, tmp_out):
    vals = [("a", 0.1, 1e-7, 123456789.123, -2.5e300), ("b", -0.0, 1.0 / 3, 2.0 ** 60, 5e-324)]
    df = spark.createDataFrame(vals, "id string, x1 double, y1 double, x2 double, y2 double")
    write_result(box_csv_lines(df), f"{tmp_out}/csv", "text")
    back = read_boxes(spark, f"{tmp_out}/csv")
    assert sorted(tuple(r) for r in back.collect()) == sorted(vals)


def test_ingest_layers(spark, tmp_out):
    from quadrille.sources.ingest import ingest_layers
    import os
    src = f"{tmp_out}/src"
    os.makedirs(src)
    _write(src, "JoinQueryRectangle.csv", ["0,A,0,0,4,4", "0,B,1,1,3,3"])
    _write(src, "ConvexHullTestData.csv", ["0,p,1,2", "0,q,3,4", "0,r,5,0"])
    out = ingest_layers(spark, src, f"{tmp_out}/dst",
                        layers={"JoinQueryRectangle": "boxes", "ConvexHullTestData": "points"})
    assert spark.read.parquet(out["JoinQueryRectangle"]).count() == 2
    pts = spark.read.parquet(out["ConvexHullTestData"])
    assert pts.columns == ["id", "x", "y"] and pts.count() == 3


def test_ingest_spreads_hot_value(spark, tmp_out):
    # a third of the rows are one exact copy: they must not land in one file
    lines = [f"0,r{i},{i % 50},{i % 7},{i % 50 + 1},{i % 7 + 1}" for i in range(600)] + ["0,hot,5,5,6,6"] * 300
    src = _write(tmp_out, "hot.csv", lines)
    t = ingest(spark, src, f"{tmp_out}/hot", "boxes", partitions=6)
    assert t.count() == 900
    per_file = spark.read.parquet(f"{tmp_out}/hot").groupBy(
        __import__("pyspark.sql.functions", fromlist=["input_file_name"]).input_file_name()).count().collect()
    assert len(per_file) >= 4 and max(r["count"] for r in per_file) < 300


def test_ingested_files_are_tight_on_both_axes(spark, tmp_out):
    """A small window meets few files by their statistics on x and by those on y."""
    import glob
    import random

    import pyarrow.parquet as pq

    rng = random.Random(3)
    # uneven: three quarters of the points crowd one corner
    points = [(rng.random() ** 4 * 100, rng.random() ** 4 * 100) for _ in range(6000)]
    src = _write(tmp_out, "curve.csv", [f"0,{i},{x!r},{y!r}" for i, (x, y) in enumerate(points)])
    ingest(spark, src, f"{tmp_out}/curve", "points", partitions=16)
    bounds = {c: [] for c in ("x", "y")}
    for f in glob.glob(f"{tmp_out}/curve/*.parquet"):
        meta = pq.read_metadata(f)
        for g in range(meta.num_row_groups):
            for j in range(meta.num_columns):
                column = meta.row_group(g).column(j)
                if column.path_in_schema in bounds:
                    bounds[column.path_in_schema].append((column.statistics.min, column.statistics.max))
    assert len(bounds["x"]) >= 12
    for axis in range(2):
        at = sorted(p[axis] for p in points)[3000]
        met = [lo <= at <= hi for lo, hi in bounds["xy"[axis]]]
        assert 0 < sum(met) <= len(met) * 0.6
    middle = [sorted(p[a] for p in points)[3000] for a in range(2)]
    both = [a[0] <= middle[0] <= a[1] and b[0] <= middle[1] <= b[1] for a, b in zip(bounds["x"], bounds["y"])]
    assert sum(both) <= 4
