"""Connected components of an edge table, by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def _least(edges: DataFrame) -> DataFrame:
    """For each node u of the edges (u, v): the least of u and its neighbours. Partially aggregated, so a hub costs a sum."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each neighbour above u goes to the least node of u's neighbourhood."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = both.join(_least(both), F.col("u") == F.col("k"))
    return joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each neighbour at or below u, and u, goes to the least of them. The edges have u > v."""
    joined = edges.join(_least(edges), F.col("u") == F.col("k"))
    down = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = joined.select(F.col("u"), F.col("m").alias("v"))
    return down.union(own).filter("u > v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge between two different nodes; the component is its smallest node.

    Each round is a table in the shared folder. The rounds end when the stars no longer change, which a count and a sum
    of hashes tell; their number grows with the logarithm of the component size.
    """
    stars = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).filter("u > v").distinct()
    before = None
    while True:
        stars = written(_small_star(_large_star(stars)), "stars")
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if before is not None and tuple(now) == tuple(before):
            break
        before = now
        if not now[0]:
            break
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
