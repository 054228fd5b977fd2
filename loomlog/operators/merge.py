"""Keyed upserts with one merge policy per column, as a DataFrame function (Parquet tables have no MERGE).

KEEP: the first known value. UPDATE: the latest known value. MAX, MIN: of the known values. OR: true if any is. MERGE: string
maps laid over each other, later entries win. NOTHING: the values of the first row that was ever written, as they were.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POLICIES = ("KEEP", "UPDATE", "MAX", "MIN", "OR", "MERGE", "NOTHING")


@dataclass(frozen=True)
class MergeSpec:
    """Key columns, each other column's policy (default for the rest), and the column that orders observations."""

    key: tuple[str, ...]
    policies: Mapping[str, str]
    order: str
    default: str = "UPDATE"

    def aggregate(self, name: str) -> Column:
        policy, value, at = self.policies.get(name, self.default), F.col(name), F.struct("_incoming", F.col(self.order))
        known = F.when(value.isNotNull(), at)
        if policy == "KEEP":
            return F.min_by(value, known).alias(name)
        if policy == "UPDATE":
            return F.max_by(value, known).alias(name)
        if policy == "NOTHING":
            return F.min_by(F.struct(value.alias("v")), at)["v"].alias(name)
        if policy == "MAX":
            return F.max(value).alias(name)
        if policy == "MIN":
            return F.min(value).alias(name)
        if policy == "OR":
            return F.bool_or(value).alias(name)
        if policy == "MERGE":
            ordered = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(at.alias("at"), F.map_entries(value).alias("e")))))
            flat = F.flatten(F.transform(ordered, lambda x: x["e"]))
            names = F.array_distinct(F.transform(flat, lambda e: e["key"]))
            last = lambda n: F.element_at(F.filter(flat, lambda e: e["key"] == n), -1)["value"]
            return F.when(F.count(value) > 0, F.map_from_arrays(names, F.transform(names, last))).alias(name)
        raise ValueError(f"unknown policy {policy}")

    def merge(self, old: DataFrame, new: DataFrame) -> DataFrame:
        """One row per key from both tables; what is stored came before what comes in, so merging again changes nothing. The key is hashed once; every policy but MERGE is combined before the shuffle."""
        both = old.withColumn("_incoming", F.lit(0)).unionByName(new.withColumn("_incoming", F.lit(1)), allowMissingColumns=True)
        values = [c for c in both.columns if c not in (*self.key, self.order, "_incoming")]
        return both.groupBy(*self.key).agg(*[self.aggregate(c) for c in values], F.max(self.order).alias(self.order))


def changes(old: DataFrame, new: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row: how many keys of new are inserted, updated (some column differs, nulls compare equal) or unchanged."""
    o = old.select(*key, *[F.col(c).alias(f"_old_{c}") for c in columns], F.lit(True).alias("_in_old"))
    n = new.select(*key, *columns, F.lit(True).alias("_in_new"))
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_old_{c}"))
    both = F.col("_in_old").isNotNull() & F.col("_in_new").isNotNull()
    return o.join(n, list(key), "full").agg(
        F.count_if(F.col("_in_old").isNull()).alias("inserted"),
        F.count_if(both & differs).alias("updated"),
        F.count_if(both & ~differs).alias("unchanged"),
        F.count_if(F.col("_in_new").isNull()).alias("missing"),
    )


def accepted_snapshots(rows: DataFrame, key: Sequence[str], written: str, terminal: str) -> DataFrame:
    """The snapshot of each key that counts: the latest written, at equal times a terminal one before an active one."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in key]), F.struct(F.col(written), F.col(terminal).cast("int"))).alias("_s")).select(*key, "_s.*")


def known_sum(value: Column) -> Column:
    """The sum if every value is known, else null: unknown isn't zero."""
    return F.when(F.count(value) == F.count("*"), F.sum(value))
