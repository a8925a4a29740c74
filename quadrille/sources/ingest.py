"""O11: layer ingest (comma text -> validated Parquet table along a curve).

The reference copied its six input files into HDFS.  Here a layer is read
from text with the shared parser (malformed lines fail or are dropped),
range-partitioned and sorted along a Z-order curve, then written as Parquet.
The curve runs through a grid of ``2**BITS`` x ``2**BITS`` cells whose borders are
quantiles of x and of y, so cells hold about as many rows each however uneven
the layer is.  A file or row group is a stretch of the curve: its min/max
statistics are tight on x *and* y, so window queries and grid joins skip most of
the data at the scan on both axes.  Ties, and exact copies, are spread by a row
id in the range key, so a hot value never fills one partition.
``layout="x"`` sorts by (x, y) instead (tight on x only).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.sources.readers import read_boxes, read_points

KINDS = {"points": ("x", "y"), "boxes": ("x1", "y1")}
BITS = 7  # quantile cells per axis: 2**BITS
ACCURACY = 10_000  # of the quantiles: ranks within rows / ACCURACY


def curve_key(df: DataFrame, x: str, y: str) -> Column:
    """Place on the Z-order curve of the quantile cell of ``(x, y)`` (one aggregate)."""
    shares = [i / 2 ** BITS for i in range(1, 2 ** BITS)]
    cuts = df.agg(*[F.percentile_approx(c, shares, ACCURACY).alias(c) for c in (x, y)]).first()
    key = F.lit(0).cast("long")

    def below(c: str):
        return lambda border: border < F.col(c)

    for shift, c in ((1, x), (0, y)):
        borders = F.array(*[F.lit(float(v)) for v in sorted(set(cuts[c] or []))]).cast("array<double>")
        cell = F.size(F.filter(borders, below(c))).cast("long")
        for bit in range(BITS):
            key = key.bitwiseOR(F.shiftleft(F.shiftright(cell, bit).bitwiseAND(F.lit(1).cast("long")), 2 * bit + shift))
    return key


def ingest(spark: SparkSession, src: str | list[str], table_path: str, kind: str,
           on_bad: str = "fail", partitions: int | None = None, sort: bool = True, layout: str = "curve") -> DataFrame:
    """Read a text layer, write it as Parquet, return the written table."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {tuple(KINDS)}")
    if layout not in ("curve", "x"):
        raise ValueError("layout must be 'curve' or 'x'")
    df = read_points(spark, src, on_bad=on_bad) if kind == "points" else read_boxes(spark, src, on_bad=on_bad)
    if sort:
        kx, ky = KINDS[kind]
        # a row id as the last range key splits runs of equal values, exact
        # copies included, over several partitions instead of one.  The id comes
        # from the file split and row position, so a recomputed task reproduces it.
        place = curve_key(df, kx, ky) if layout == "curve" else F.lit(0).cast("long")
        df = df.withColumn("_place", place).withColumn("_row", F.monotonically_increasing_id())
        keys = ["_place", kx, ky, "_row"]
        df = (df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys))
        df = df.sortWithinPartitions("_place", kx, ky).drop("_place", "_row")
    df.write.mode("overwrite").parquet(table_path)
    return spark.read.parquet(table_path)


def ingest_layers(spark: SparkSession, src_dir: str, dst_dir: str, layers: dict[str, str],
                  on_bad: str = "fail") -> dict[str, str]:
    """Ingest ``<src_dir>/<name>.csv`` for each layer to ``<dst_dir>/<name>``;
    ``layers`` maps names to kinds."""
    out = {}
    for name, kind in layers.items():
        path = f"{dst_dir.rstrip('/')}/{name}"
        ingest(spark, f"{src_dir.rstrip('/')}/{name}.csv", path, kind, on_bad)
        out[name] = path
    return out
