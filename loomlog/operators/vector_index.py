"""Nearest vectors by inverted lists: rows lie in folders by their nearest centre, and a query reads the folders of its nearest centres.

Centres come from a k-means over a bounded sample of rows (SAMPLE, those with the smallest hash of their id, so that the same table gives
the same centres); every row is indexed. Vectors are compared by cosine, as unit vectors. A search filters first: where at most EXACT rows
pass, all of them are compared, as a list may hold none of them; beyond that `probes` lists are read for each query, and only these
folders are listed and scanned. exact=True reads all.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .vectors import dot, normalised

#: Rows that the centres are fitted on, their rounds, the most lists, and rows up to which a search is exact.
SAMPLE, ROUNDS, MOST_LISTS, EXACT = 10_000, 12, 4_096, 50_000
#: Lists that a query reads, and queries that are broadcast at a time.
PROBES, QUERY_BLOCK = 16, 10_000
#: Rows of a list that one task writes.
LIST_ROWS = 50_000


def unit(vector: Column) -> Column:
    """The vector as doubles of length one; null if it is null, empty, zero or holds a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when((F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), normalised(vector))


def _centres(sample: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means: each centre is the direction of its rows' sum. A centre without rows takes the row that fits worst."""
    centres = sample[np.linspace(0, len(sample) - 1, lists).astype(int)]
    for _ in range(rounds):
        fit = sample @ centres.T
        nearest, best = fit.argmax(axis=1), fit.max(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        empty = np.flatnonzero(np.bincount(nearest, minlength=lists) == 0)
        sums[empty] = sample[np.argsort(best, kind="stable")[: len(empty)]]
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.where(length > 0, length, 1), centres)
    return centres


def build(rows: DataFrame, id: str, vector: str, folder: str, lists: int | None = None, sample: int = SAMPLE) -> int:
    """Writes the index of rows (all their columns, the vector as unit vector v) and gives its number of lists: about the square root of the
    number of rows, unless told. Rows without a unit vector aren't indexed; all vectors have one length. Rows of a large list are dealt to
    several tasks by their id."""
    given = rows.withColumn("v", unit(F.col(vector))).drop(vector).filter("v IS NOT NULL")
    n = given.count()
    picked = given.select("v").orderBy(F.xxhash64(id), id).limit(sample).collect()  # bounded
    lists = max(1, min(lists or round(math.sqrt(n)), MOST_LISTS, len(picked) or 1))
    centres = _centres(np.array([r["v"] for r in picked], dtype=np.float64), lists) if n else np.zeros((0, 1))
    spark = rows.sparkSession
    told = spark.sparkContext.broadcast(centres)  # at most MOST_LISTS rows

    @F.pandas_udf("int")
    def nearest(v: pd.Series) -> pd.Series:
        return pd.Series((np.stack(v.to_list()) @ told.value.T).argmax(axis=1) if len(v) else [], dtype="int32")

    salt = F.pmod(F.xxhash64(id), F.lit(max(1, n // LIST_ROWS)))
    given.withColumn("list", nearest("v")).repartition("list", salt).write.mode("overwrite").partitionBy("list").parquet(f"{folder}/rows")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centre array<double>").write.mode("overwrite").parquet(f"{folder}/centres")
    return lists


def _best(scored: DataFrame, id: str, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), id))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def search(spark: SparkSession, folder: str, queries: DataFrame, id: str, k: int = 10, probes: int = PROBES, only: Column | None = None, exact: bool = False, threshold: int = EXACT) -> DataFrame:
    """query_id, rank, id, score (cosine) and the rows' other columns: the k nearest rows that pass `only`, ties to smaller ids.

    queries: query_id, vector. Queries without a unit vector have no rows, nor has an empty index. More than QUERY_BLOCK queries are asked
    in blocks of about so many.
    """
    asked = queries.select("query_id", unit(F.col("vector")).alias("q")).filter("q IS NOT NULL")
    blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    rows = spark.read.parquet(f"{folder}/rows") if blocks else None
    passing = rows if only is None else rows.filter(only)
    # whether more than so many pass is told by so many rows and one
    whole = exact or passing.select("list").limit(threshold + 1).count() <= threshold
    parts = [_asked(spark, folder, passing, asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b), id, k, probes, whole) for b in range(blocks)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _asked(spark: SparkSession, folder: str, passing: DataFrame, asked: DataFrame, id: str, k: int, probes: int, whole: bool) -> DataFrame:
    if whole:  # a stated set of queries, a block at a time, against all rows
        met = passing.join(F.broadcast(asked), F.lit(True))
    else:
        centres = spark.read.parquet(f"{folder}/centres")
        near = asked.join(F.broadcast(centres), F.lit(True)).withColumn("score", dot(F.col("q"), F.col("centre")))
        chosen = _best(near, "list", probes).select("query_id", "q", "list")
        lists = [r["list"] for r in chosen.select("list").distinct().collect()]  # at most MOST_LISTS numbers: the folders to read
        met = passing.filter(F.col("list").isin(lists)).join(chosen, "list")
    scored = met.withColumn("score", dot(F.col("v"), F.col("q")))
    return _best(scored, id, k).drop("v", "q", "list")
