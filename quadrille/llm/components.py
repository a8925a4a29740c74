"""Connected components of a table of links, by alternating stars.

Every round hangs each node's neighbours on its smallest neighbour (large star,
then small star) until nothing moves.  Minima are aggregates with a map-side
half; the join back is of two exchanged sides, so a node with very many links is
split over tasks.  Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import write_table


def _size(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first())


def _hang(pairs: DataFrame, upward: bool) -> DataFrame:
    """One star: links (u, v) become (v, smallest of u's neighbourhood)."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    least = write_table(least, "stars")
    met = pairs.join(least, pairs["u"] == least["c"])
    if upward:
        moved = met.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = met.select("v", "m").unionByName(least.select(F.col("c").alias("v"), "m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where(F.col("u") != F.col("v")).distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with a link to another; root is the smallest."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u") != F.col("v")).distinct()
    edges = write_table(edges, "links")
    size = _size(edges)
    while size[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = write_table(_hang(both, True), "large_star")
        edges = write_table(_hang(large, False), "small_star")
        before, size = size, _size(edges)
        if size == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
