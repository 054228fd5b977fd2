"""What the operators of this subpackage share: intermediate tables and word-level Arrow helpers."""

from __future__ import annotations

import atexit
import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.session import spread

#: A word, in every operator here: a maximal run of characters other than these six.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
#: Bytes of text that one step of a Python worker holds as words at once (a single longer text is a step of its own).
STEP_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session takes a folder of
    this machine; any other is asked to name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.gettempdir()}/loomlog-checkpoints"
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may have ended before the interpreter does
        pass


#: Written tables that still exist: path to session.
_TABLES: dict[str, SparkSession] = {}


def told_apart(names: list[str]) -> list[str]:
    """The names, those that differ in case only (or not at all) told apart by a number: a table can hold no such two. The one
    in small letters keeps its name, else the first."""
    out, taken = list(names), {n.lower() for n in names}
    for lower in taken.copy():
        alike = [i for i, n in enumerate(names) if n.lower() == lower]
        keeps = next((i for i in alike if names[i] == lower), alike[0])
        number = 2
        for i in alike:
            if i != keeps:
                while f"{lower}_{number}" in taken:
                    number += 1
                out[i] = f"{names[i]}_{number}"
                taken.add(f"{lower}_{number}")
    return out


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors. It goes at the end of the
    passing_tables block that it was written in, else when the driver's Python ends. Columns of like names are renamed (told_apart)."""
    path = f"{shared_folder(df.sparkSession)}/loomlog-{name}-{uuid.uuid4().hex}"
    if (names := told_apart(df.columns)) != df.columns:
        df = df.toDF(*names)
    df.write.parquet(path)
    _TABLES[path] = df.sparkSession
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _drop(paths: Iterable[str]) -> None:
    for path in paths:
        _delete(_TABLES.pop(path), path)


@atexit.register
def _drop_all() -> None:
    _drop(list(_TABLES))


@contextmanager
def passing_tables() -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """with passing_tables() as keep: tables written inside are deleted at the end, but for those written by keep(df, name)."""
    before, kept = set(_TABLES), set()

    def keep(df: DataFrame, name: str) -> DataFrame:
        known = set(_TABLES)
        out = written(df, name)
        kept.update(set(_TABLES) - known)
        return out

    try:
        yield keep
    finally:
        _drop([path for path in _TABLES if path not in before and path not in kept])


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python workers a thousand rows at a time, unless the session asks for a number of its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "1000")


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1, ... by place, so that no name of its own, doubled or not, clashes with ours."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def place_of(df: DataFrame, name: str) -> str:
    """The name in numbered(df) of df's column of exactly that name (the first, if several)."""
    return f"c{df.columns.index(name)}"


def picked(df: DataFrame, **names: str) -> DataFrame:
    """df's columns of the given names under the keywords, and nothing else; a doc_id becomes a long.

    Columns that have their name and type already are taken without an alias, so that plans which read a table twice stay
    equal and Spark shuffles it once. A table with texts in fewer files than there are cores is dealt out over them.
    """
    if "text" in names:
        small_batches(df.sparkSession)
    lower = [c.lower() for c in df.columns]
    if all(own == name and lower.count(name.lower()) == 1 for own, name in names.items()):
        out = df.select(*names)
    else:
        out = numbered(df).select(*[F.col(place_of(df, name)).alias(own) for own, name in names.items()])
    if dict(out.dtypes).get("doc_id", "bigint") != "bigint":
        out = out.withColumn("doc_id", F.col("doc_id").cast("long"))
    return spread(out) if "text" in names else out


def _give_back() -> None:
    """Returns freed memory to the system: an idle worker otherwise keeps what its last task has used."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def steps(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most so many bytes of text each, one row at least."""
    try:
        yield from _slices(batches, text, limit)
    finally:
        _give_back()


def _slices(batches: Iterable[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words in order, and where each text's words begin (one offset more than texts). Null: no words."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    if not full.all():
        flat, offsets = flat.filter(pa.array(full)), np.concatenate(([0], np.cumsum(full)))[offsets]
    return flat, offsets


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word, computed once per distinct word."""
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    coded = words.dictionary_encode()
    distinct = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
    return distinct[coded.indices.to_numpy()]


_ODD = np.random.default_rng(20240229).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k words from each place on; shorter than words by k - 1."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        total += words[j : j + n] * _ODD[j % 64]
    return mixed(total)


def owners(offsets: np.ndarray) -> np.ndarray:
    """The index of the text that each word belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def longs(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)
