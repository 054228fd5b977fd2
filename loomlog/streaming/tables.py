"""Several derived tables that change together, and results that are made anew only when what they are made of has changed.

A generation is a folder of finished tables; a manifest names, for each table, the generation (and its partitions) that counts. Readers
resolve a manifest once and read only what it names, so they see all of the old tables or all of the new ones. A manifest is written
under the next number after all its tables are complete, and never changed: a rebuild that is killed leaves nothing that is named, and of
two that race for a number one fails.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.operators.merge import MergeSpec

#: Seconds within which a result is not made anew, and after which it is even if nothing has changed.
LEAST_AGE, MOST_AGE = 60, 900


class Store:
    """Small files and listings of any store that Spark reads."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, inside: str) -> list[str]:
        at = self._path(f"{self.folder}/{inside}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(f"{self.folder}/{name}"))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """Writes a file that must not exist; it appears whole, by a rename."""
        end = self._path(f"{self.folder}/{name}")
        if self._fs.exists(end):
            raise FileExistsError(name)
        part = self._path(f"{self.folder}/{name}.part-{hashlib.sha256(text.encode()).hexdigest()[:8]}")
        stream = self._fs.create(part, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self._fs.rename(part, end):
            raise FileExistsError(name)

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.folder}/{name}"), True)


class TableSet:
    """Tables below a folder that change by manifests: manifests/<number>.json and tables/<generation>/<table>/bucket=<n>."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.buckets, self.store = spark, buckets, Store(spark, folder)

    def number(self) -> int:
        """The number of the manifest that counts; 0 if there is none."""
        return max((int(n[:-5]) for n in self.store.names("manifests") if n.endswith(".json")), default=0)

    def manifest(self, number: int | None = None) -> dict:
        number = self.number() if number is None else number
        return json.loads(self.store.read(f"manifests/{number:012d}.json")) if number else {"tables": {}}

    def read(self, table: str, number: int | None = None) -> DataFrame | None:
        """A table as one manifest names it. Readers of several tables give all the same number."""
        entry = self.manifest(number)["tables"].get(table)
        if entry is None:
            return None
        paths = [f"{self.store.folder}/tables/{generation}/{table}/bucket={b}" for b, generation in entry["buckets"].items()]
        schema = entry["schema"]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _bucket(self, key: Sequence[str]):
        return F.pmod(F.xxhash64(*key), F.lit(self.buckets)).cast("int")

    def _write(self, df: DataFrame, table: str, key: Sequence[str], generation: str) -> dict[str, str]:
        rows = df.withColumn("bucket", self._bucket(key))
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.store.folder}/tables/{generation}/{table}")
        return {n.split("=")[1]: generation for n in self.store.names(f"tables/{generation}/{table}") if n.startswith("bucket=")}

    def rebuild(self, tables: Mapping[str, tuple[DataFrame, Sequence[str]]], generation: str) -> int:
        """Writes all tables (each with its key) anew and then names them at once. The new manifest's number."""
        before = self.number()
        named = {t: {"key": list(key), "schema": _ddl(df), "buckets": self._write(df, t, key, generation)} for t, (df, key) in tables.items()}
        return self._publish(before, named, {})

    def upsert(self, batches: Mapping[str, tuple[DataFrame, MergeSpec]], generation: str) -> int:
        """Merges batches into tables and names the result at once. Only buckets that a batch has keys of are read and written; all
        others stay the files they are."""
        before = self.number()
        old = self.manifest(before)["tables"]
        named = {}
        for table, (batch, spec) in batches.items():
            entry = old.get(table, {"key": list(spec.key), "schema": _ddl(batch), "buckets": {}})
            touched = sorted(str(r[0]) for r in batch.select(self._bucket(spec.key)).distinct().collect())  # at most self.buckets
            paths = [f"{self.store.folder}/tables/{entry['buckets'][b]}/{table}/bucket={b}" for b in touched if b in entry["buckets"]]
            stored = self.spark.read.schema(entry["schema"]).parquet(*paths) if paths else batch.limit(0)
            merged = spec.merge(stored, batch)
            named[table] = {"key": list(spec.key), "schema": _ddl(merged), "buckets": entry["buckets"] | self._write(merged, table, spec.key, generation)}
        return self._publish(before, named, old)

    def _publish(self, before: int, named: dict, old: dict) -> int:
        self.store.create(f"manifests/{before + 1:012d}.json", json.dumps({"tables": old | named}, sort_keys=True))
        return before + 1

    def sweep(self, keep: int = 2) -> list[str]:
        """Deletes generations that none of the last `keep` manifests names, and older manifests; what was deleted. Run it when no
        rebuild is under way."""
        numbers = [int(n[:-5]) for n in self.store.names("manifests") if n.endswith(".json")][-keep:]
        live = {g for n in numbers for e in self.manifest(n)["tables"].values() for g in e["buckets"].values()}
        gone = [g for g in self.store.names("tables") if g not in live]
        for g in gone:
            self.store.delete(f"tables/{g}")
        for name in self.store.names("manifests"):
            if name.endswith(".json") and int(name[:-5]) not in numbers:
                self.store.delete(f"manifests/{name}")
        return gone


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def listing_token(spark: SparkSession, *folders: str) -> str:
    """A token that changes when a file of the folders comes, goes or changes: their names, sizes and times, without reading them."""
    total = hashlib.sha256()
    for folder in folders:
        store = Store(spark, folder)
        root = store._path(store.folder)
        files = []
        if store._fs.exists(root):
            found = store._fs.listFiles(root, True)
            while found.hasNext():
                s = found.next()
                files.append(f"{s.getPath()} {s.getLen()} {s.getModificationTime()}")
        total.update("\n".join([folder, *sorted(files)]).encode() + b"\0")
    return total.hexdigest()


class Gated:
    """Results kept below a folder, each with the token of what it was made of and when."""

    def __init__(self, spark: SparkSession, folder: str, least: int = LEAST_AGE, most: int = MOST_AGE):
        self.spark, self.store, self.least, self.most = spark, Store(spark, folder), least, most

    def result(self, name: str, token: str, make: Callable[[], DataFrame], now: float) -> DataFrame:
        """The kept result if it is younger than `least`, or if the token is the same and it is younger than `most`; else made anew.

        A result that can't be made leaves the kept one; the error is raised."""
        known = [n[:-5] for n in self.store.names(name) if n.endswith(".json")]
        last = json.loads(self.store.read(f"{name}/{known[-1]}.json")) if known else None
        if last and (now - last["at"] < self.least or (last["token"] == token and now - last["at"] < self.most)):
            return self.spark.read.schema(last["schema"]).parquet(f"{self.store.folder}/{name}/{known[-1]}")
        number = f"{int(known[-1]) + 1 if known else 1:012d}"
        made = make()
        made.write.mode("overwrite").parquet(f"{self.store.folder}/{name}/{number}")
        self.store.create(f"{name}/{number}.json", json.dumps({"token": token, "at": now, "schema": _ddl(made)}))
        for old in known[:-1]:  # the one before may still be read
            self.store.delete(f"{name}/{old}.json")
            self.store.delete(f"{name}/{old}")
        return self.spark.read.schema(_ddl(made)).parquet(f"{self.store.folder}/{name}/{number}")
