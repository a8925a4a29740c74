import os

from quadrille.plans import jobs


def _write(folder, name, lines):
    p = f"{folder}/{name}"
    with open(p, "w") as f:
        f.write("\n".join(lines) + "\n")
    return p


def _read(spark, path):
    return [r.value for r in spark.read.text(path).collect()]


def test_range_and_join_jobs(spark, tmp_out):
    boxes = _write(tmp_out, "r.csv", ["0,1,0.5,0.5,0.7,0.9", "0,2,0.5,0.5,1.5,0.9", "0,3,1,1,0,0"])
    out = jobs.range_query_job(spark, boxes, f"{tmp_out}/range", (0, 0, 1, 1))
    assert sorted(_read(spark, out)) == ["ID: 1  Coordinates:  0.5, 0.5;   0.7,  0.9",
                                         "ID: 3  Coordinates:  1.0, 1.0;   0.0,  0.0"]
    rects = _write(tmp_out, "rect.csv", ["0,A,0,0,4,4", "0, B ,1,1,3,3"])
    pairs = _write(tmp_out, "pt.csv", ["0,p,2,2,2.5,2.5", "0,q,9,9,9.5,9.5"])
    out = jobs.spatial_join_job(spark, pairs, rects, f"{tmp_out}/join")
    assert sorted(_read(spark, out)) == ["p: A,B", "q: "]


def test_point_jobs_single_file(spark, tmp_out):
    pts = _write(tmp_out, "p.csv", ["0,a,0,0", "0,b,2,0", "0,c,2,2", "0,d,0,2", "0,e,1,1", "0,f,0.5,0.5"])
    out = jobs.convex_hull_job(spark, pts, f"{tmp_out}/hull", single_file=True)
    assert len([f for f in os.listdir(out) if f.startswith("part-")]) == 1
    assert _read(spark, out) == ["0.0,  0.0", "0.0,  2.0", "2.0,  2.0", "2.0,  0.0"]
    assert _read(spark, jobs.farthest_pair_job(spark, pts, f"{tmp_out}/far")) == ["0.0,0.0", "2.0,2.0"]
    assert _read(spark, jobs.closest_pair_job(spark, pts, f"{tmp_out}/near")) == ["0.0,  0.0", "0.5,  0.5"]


def test_union_job_and_cli(spark, tmp_out):
    boxes = _write(tmp_out, "u.csv", ["0,0,0,0,1,1", "0,0,1,0,2,1"])
    out = jobs.union_job(spark, boxes, f"{tmp_out}/union")
    assert sorted(_read(spark, out)) == ["0.0, 0.0", "0.0, 1.0", "2.0, 0.0", "2.0, 1.0"]
    jobs.main(["union", boxes, f"{tmp_out}/union2", "--single-file"])
    assert sorted(_read(spark, f"{tmp_out}/union2")) == sorted(_read(spark, out))
