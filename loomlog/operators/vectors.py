"""Vectors as arrays of doubles, with higher-order functions: no Python in the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where either is all zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def normalised(a: Column, dims: int | None = None) -> Column:
    """The first dims components, at unit length; an all-zero vector stays as it is."""
    cut = F.slice(as_double(a), 1, dims) if dims else as_double(a)
    return F.when(norm(cut) == 0, cut).otherwise(F.transform(cut, lambda x: x / norm(cut)))


def mean_vector(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector): component-wise means. Only (key, place) sums are shuffled, never a group's vectors."""
    parts = rows.select(key, F.posexplode(as_double(F.col(vector))).alias("at", "x")).groupBy(key, "at").agg(F.avg("x").alias("x"))
    return parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias(vector))


def vector_of(rows: DataFrame, vector: str) -> list[float]:
    """The vector of the only row, to ask with; without a row (or a vector) an empty one, which nothing is near to."""
    row = rows.select(vector).first()
    return list(row[0]) if row and row[0] is not None else []


def _asked(query: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in query]).cast("array<double>")


def nearest(rows: DataFrame, id: str, vector: str, query: list[float], k: int, max_distance: float | None = None, digits: int | None = None) -> DataFrame:
    """The k rows of least cosine distance to a query: a scan and a top-k within each task before the final one.

    Ties go to the smaller id; with digits, distances are rounded first, so that nearly equal ones tie.
    """
    distance = F.lit(1.0) - cosine(F.col(vector), _asked(query))
    found = rows.select(id, (distance if digits is None else F.round(distance, digits)).alias("distance"))
    if max_distance is not None:
        found = found.filter(F.col("distance") <= max_distance)
    return found.filter("distance IS NOT NULL").orderBy("distance", id).limit(k)


def similar_pairs(means: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, other, similarity) of each two keys (key < other): components meet by their place, products are summed by pair, so
    no task holds all vectors."""
    unit = means.select(key, F.posexplode(normalised(F.col(vector))).alias("at", "x"))
    other = unit.select(F.col(key).alias("other"), "at", F.col("x").alias("y"))
    return unit.join(other, "at").filter(F.col(key) < F.col("other")).groupBy(key, "other").agg(F.sum(F.col("x") * F.col("y")).alias("similarity"))


def best_chunks(rows: DataFrame, doc: str, id: str, vector: str, query: list[float], k: int, max_distance: float | None = None, digits: int | None = None) -> DataFrame:
    """(doc, distance): the k nearest documents, each at its best chunk's distance; filters on rows come first, so none is fetched
    in vain."""
    distance = F.lit(1.0) - cosine(F.col(vector), _asked(query))
    found = rows.select(doc, (distance if digits is None else F.round(distance, digits)).alias("distance")).filter("distance IS NOT NULL")
    best = found.groupBy(doc).agg(F.min("distance").alias("distance"))
    return (best if max_distance is None else best.filter(F.col("distance") <= max_distance)).orderBy("distance", doc).limit(k)


def vector_ranks(nearest: DataFrame, id: str, k: int = 60) -> DataFrame:
    """The list of a vector search alone: rank by distance, then id, and 1 / (k + rank) as score. For a search's few rows."""
    w = Window.partitionBy(F.lit(0)).orderBy("distance", id)
    return nearest.withColumn("rank", F.row_number().over(w)).withColumn("score", 1 / (k + F.col("rank")))
