"""Operators over time-ordered rows: as-of joins, validity ranges, gaps, counters.

As-of joins are a union and one window over the key, not a join on a range: linear in the rows, one shuffle, and Catalyst
keeps the rest of the plan. Rows with a null key or time match nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _both(left: DataFrame, right: DataFrame, on: Sequence[str], at: str, right_at: str, carry: str) -> DataFrame:
    """Rows of both sides in one frame: the left as a struct _l, the right as a struct carry."""
    keys = [F.col(k) for k in on]
    l_rows = left.select(*keys, F.col(at).alias("_t"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(F.struct(*right.columns).alias("s")).schema["s"].dataType).alias(carry))
    r_rows = right.select(*keys, F.col(right_at).alias("_t"), F.lit(None).cast(l_rows.schema["_l"].dataType).alias("_l"), F.struct(*right.columns).alias(carry))
    return l_rows.unionByName(r_rows.filter(F.col("_t").isNotNull()))


def asof_forward(left: DataFrame, right: DataFrame, on: Sequence[str], at: str, right_at: str, tie: str, name: str = "next") -> DataFrame:
    """Each left row with the first right row strictly later (struct column name, null if none); ties by the least tie."""
    both = _both(left, right, on, at, right_at, name)
    # right rows from the latest backwards; at equal times left rows come after, so that equality doesn't match
    order = [F.col("_t").desc(), F.col("_l").isNull().cast("int"), F.col(f"{name}.{tie}").desc()]
    found = F.last(name, ignorenulls=True).over(Window.partitionBy(*on).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn(name, found).filter(F.col("_l").isNotNull()).select("_l.*", name)


def asof_backward(left: DataFrame, right: DataFrame, on: Sequence[str], at: str, right_at: str, tie: str, name: str = "last") -> DataFrame:
    """Each left row with the last right row not later (struct column name, null if none); ties by the greatest tie."""
    both = _both(left, right, on, at, right_at, name)
    order = [F.col("_t"), F.col("_l").isNotNull().cast("int"), F.col(f"{name}.{tie}")]
    found = F.last(name, ignorenulls=True).over(Window.partitionBy(*on).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn(name, found).filter(F.col("_l").isNotNull()).select("_l.*", name)


def validity(prices: DataFrame, key: str, since: str) -> DataFrame:
    """A slowly changing table with the end of each row's validity (until, exclusive; null: still valid)."""
    return prices.withColumn("until", F.lead(since).over(Window.partitionBy(key).orderBy(since)))


def valid_at(rows: DataFrame, prices: DataFrame, key: str, at: str, since: str) -> DataFrame:
    """Left join of each row to the version of its key that is valid at a time. Equal keys meet, the range is a filter."""
    p = validity(prices, key, since).withColumnRenamed(key, "_key")
    inside = (F.col(at) >= F.col(since)) & (F.col("until").isNull() | (F.col(at) < F.col("until")))
    return rows.join(p, (F.col(key) == F.col("_key")) & inside, "left").drop("_key", "until", since)


def latest_per_key(rows: DataFrame, key: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in the order, by row_number."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


def seconds_between(later: Column, earlier: Column) -> Column:
    """Whole seconds, from microseconds, between two timestamps of either kind."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.floor((micros(later) - micros(earlier)) / 1_000_000)


def active_seconds(rows: DataFrame, key: Sequence[str], at: str, tie: str, gap: int = 300) -> DataFrame:
    """Sum of the gaps between a key's successive rows that are at most gap seconds long."""
    step = seconds_between(F.col(at), F.lag(at).over(Window.partitionBy(*key).orderBy(at, tie)))
    return rows.withColumn("_gap", step).groupBy(*key).agg(F.coalesce(F.sum(F.when(F.col("_gap") <= gap, F.col("_gap"))), F.lit(0)).alias("active_seconds"))


def gap_sessions(rows: DataFrame, key: Sequence[str], at: str, tie: str, gap: int) -> DataFrame:
    """rows with session_no: a new session begins after more than gap seconds without a row."""
    w = Window.partitionBy(*key).orderBy(at, tie)
    new = F.coalesce((seconds_between(F.col(at), F.lag(at).over(w)) > gap).cast("int"), F.lit(1))
    return rows.withColumn("_new", new).withColumn("session_no", F.sum("_new").over(w)).drop("_new")


def reset_adjusted(rows: DataFrame, key: Sequence[str], value: str, *order: Column) -> DataFrame:
    """rows with adjusted: the running total of a counter that may restart; a fall counts the new value whole.

    A fall is no restart if the value before it had a fraction and both agree to 12 significant digits: that is rounding.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    prev, now = F.lag(value).over(w), F.col(value)
    rounding = (prev != F.floor(prev)) & (F.format_string("%.11e", prev) == F.format_string("%.11e", now))
    step = F.when(prev.isNull(), now).when(now >= prev, now - prev).when(rounding, F.lit(0.0)).otherwise(now)
    return rows.withColumn("_step", step).withColumn("adjusted", F.sum("_step").over(w)).drop("_step")


def near_in_time(left: DataFrame, right: DataFrame, on: Sequence[str], at: str, right_at: str, seconds: int, width: int | None = None) -> DataFrame:
    """Pairs of equal key at most so many seconds apart. Buckets of time turn the range into an equi-join on three buckets."""
    size = width or seconds
    bucket = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / size)
    l_rows = left.withColumn("_b", F.explode(F.sequence(bucket(at) - 1, bucket(at) + 1)))
    r_rows = right.withColumn("_b", bucket(right_at))
    apart = F.abs(F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.col(right_at).cast("timestamp")))
    return l_rows.join(r_rows, [*on, "_b"]).filter(apart <= seconds * 1_000_000).drop("_b")
