"""Geometry layers derived from the driver's test tables.

The test tables carry no geometry, so the layers are derived from them.
Operand order is fixed so that Spark and other engines round alike;
``e[i]`` is the 0-based ``embedding`` element widened to double.

* F1 boxes   (embeddings): id, x1, y1, x2, y2 = vec_id, e0, e1, e0+0.1*e2, e1+0.1*e3
* F2 pairs   (lineitem):   id = orderkey-linenumber-partkey-suppkey,
                           x1 = l_extendedprice/200000-0.26, y1 = l_quantity/100-0.25,
                           x2 = x1+l_discount/10, y2 = y1+l_tax/10
* F3 points  (embeddings): id, x, y = vec_id, e0, e1
* F4 points  (lineitem):   x, y = l_extendedprice, l_quantity (with duplicates)
* F6 boxes   (part):       sides from 0.0006 to 0.06 by p_size, spread over the area of F2
* F5 points  (lineitem):   F4 in cents and units, both exact integers
* F7 boxes   (part):       sides of 0.004 over the area of F2, and two of five boxes, of side 0.0002, in one corner
* F8 points  (lineitem):   F4 rounded to whole units (exact, and printed alike by other engines)
* F9 boxes   (part):       exact integers, sides p_size

Only the columns used are read, so the Parquet scan prunes the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _e(i: int):
    return F.col("embedding")[i].cast("double")


def f1_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(
        F.col("vec_id").cast("string").alias("id"),
        _e(0).alias("x1"), _e(1).alias("y1"),
        (_e(0) + F.lit(0.1) * _e(2)).alias("x2"),
        (_e(1) + F.lit(0.1) * _e(3)).alias("y2"),
    )


def f2_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    x1 = F.col("l_extendedprice") / F.lit(200000) - F.lit(0.26)
    y1 = F.col("l_quantity") / F.lit(100) - F.lit(0.25)
    return li.select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in
                           ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("id"),
        x1.alias("x1"), y1.alias("y1"),
        (x1 + F.col("l_discount") / F.lit(10)).alias("x2"),
        (y1 + F.col("l_tax") / F.lit(10)).alias("y2"),
    )


def f3_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(F.col("vec_id").cast("string").alias("id"),
                      _e(0).alias("x"), _e(1).alias("y"))


def f4_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_extendedprice").cast("double").alias("x"),
                     F.col("l_quantity").cast("double").alias("y"))


def f5_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4 scaled to integers, so that areas and squared distances are exact."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.round(F.col("l_extendedprice") * F.lit(100)).cast("double").alias("x"),
                     F.round(F.col("l_quantity")).cast("double").alias("y"))


def f6_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of widely mixed sides (a factor of 100), overlapping a lot."""
    part = table(spark, sf_dir, "part")
    x1 = (F.col("p_partkey") * F.lit(7919) % F.lit(10007)) / F.lit(20014) - F.lit(0.26)
    y1 = (F.col("p_partkey") * F.lit(104729) % F.lit(10009)) / F.lit(20018) - F.lit(0.25)
    side = F.element_at(F.array(*[F.lit(v) for v in F6_SIDES]), (F.col("p_size") % F.lit(len(F6_SIDES)) + 1).cast("int"))
    return part.select(F.col("p_partkey").cast("string").alias("id"), x1.alias("x1"), y1.alias("y1"),
                       (x1 + side).alias("x2"), (y1 + side).alias("y2"))


F6_SIDES = (0.0006, 0.002, 0.0006, 0.008, 0.0006, 0.02, 0.002, 0.06, 0.0006, 0.008)


def f7_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide boxes all over, and a crowd of narrow ones in a corner of 0.008 x 0.008."""
    part = table(spark, sf_dir, "part")
    crowd = F.col("p_partkey") % F.lit(5) < F.lit(2)
    u, v = F.col("p_partkey") * F.lit(7919) % F.lit(10007), F.col("p_partkey") * F.lit(104729) % F.lit(10009)
    x1 = F.when(crowd, u / F.lit(1250875) - F.lit(0.24)).otherwise(u / F.lit(20014) - F.lit(0.26))
    y1 = F.when(crowd, v / F.lit(1251125) - F.lit(0.204)).otherwise(v / F.lit(20018) - F.lit(0.25))
    side = F.when(crowd, F.lit(0.0002)).otherwise(F.lit(0.004))
    return part.select(F.col("p_partkey").cast("string").alias("id"), x1.alias("x1"), y1.alias("y1"),
                       (x1 + side).alias("x2"), (y1 + side).alias("y2"))


def f8_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.round(F.col("l_extendedprice")).cast("double").alias("x"),
                     F.round(F.col("l_quantity")).cast("double").alias("y"))


def f9_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    x1, y1 = F.col("p_partkey") * F.lit(7919) % F.lit(10007), F.col("p_partkey") * F.lit(104729) % F.lit(10009)
    return part.select(F.col("p_partkey").cast("string").alias("id"),
                       *[c.cast("double").alias(n) for c, n in ((x1, "x1"), (y1, "y1"), (x1 + F.col("p_size"), "x2"),
                                                                (y1 + F.col("p_size"), "y2"))])
