"""Incremental upkeep: keyed upserts into snapshot tables, a change feed, and windowed streams.

A snapshot table is a folder of immutable Parquet snapshots; the newest that was finished is the table. A refresh writes the
merged snapshot beside the old one, so readers never see half a table and a repeated batch (same id) changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.operators.merge import MergeSpec


class Snapshots:
    """The snapshots of one table below a folder of any store that Spark writes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Finished snapshots, oldest first: Spark writes _SUCCESS last."""
        if not self._fs.exists(self._path(self.folder)):
            return []
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))]
        return sorted(int(n[2:]) for n in found if n.startswith("v=") and self._fs.exists(self._path(f"{self.folder}/{n}/_SUCCESS")))

    def read(self, version: int | None = None) -> DataFrame | None:
        known = self.versions()
        at = version if version is not None else (known[-1] if known else None)
        return None if at is None else self.spark.read.parquet(f"{self.folder}/v={at}")

    def upsert(self, batch: DataFrame, spec: MergeSpec, version: int, keep: int = 2) -> bool:
        """Merges a batch as snapshot version; False if that or a later one is there already."""
        known = self.versions()
        if known and known[-1] >= version:
            return False
        old = self.read()
        # a first batch is merged with itself left out: the policies apply within it too
        merged = spec.merge(batch.limit(0) if old is None else old, batch)
        merged.write.mode("overwrite").parquet(f"{self.folder}/v={version}")
        for gone in known[: max(0, len(known) + 1 - keep)]:
            self._fs.delete(self._path(f"{self.folder}/v={gone}"), True)
        return True


def append_changes(batch: DataFrame, key: Sequence[str], folder: str, version: int) -> None:
    """The keys that a batch touched, once each, as one partition of the change feed. Writing it again replaces it."""
    batch.select(*key).distinct().withColumn("kind", F.lit("touched")).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/version={version}")


def maintain(stream: DataFrame, spec: MergeSpec, table: str, feed: str, checkpoint: str, also: Callable[[DataFrame, int], None] | None = None):
    """A started query that upserts every micro-batch into a snapshot table and appends its keys to a change feed."""

    def apply(batch: DataFrame, version: int) -> None:
        if Snapshots(batch.sparkSession, table).upsert(batch, spec, version):
            append_changes(batch, spec.key, feed, version)
        if also:
            also(batch, version)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_counts(stream: DataFrame, at: str, by: Sequence[str], late: str = "10 minutes") -> DataFrame:
    """Tumbling hours of a stream; rows later than the watermark are left out."""
    return stream.withWatermark(at, late).groupBy(F.window(at, "1 hour"), *by).agg(F.count("*").alias("n"))


def active_lanes(stream: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Session windows: lanes that a pause ends."""
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n"))
