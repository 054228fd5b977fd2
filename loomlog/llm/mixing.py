"""Mixing sources to target weights by Pfair scheduling.

A source's documents follow each other in a fixed pseudo-random order and are cut into blocks of equal bytes. Block i of a
source of weight w may be served from slot floor(i / w) on (its release) and must be by slot ceil((i + 1) / w) (its deadline).
Earliest deadline first over the released blocks then meets all deadlines, and a source's served blocks differ from w times
the slots by less than one block at any time.

Weights are rounded to multiples of 1 / RESOLUTION, and the schedule runs over the table's own blocks to the end: the driver
keeps five numbers a block (of 64 KiB, unless told otherwise), and documents look theirs up. A source that has run out leaves
its slots empty, the others keep their proportions. Nothing is dropped or repeated: the mix is an order of all documents.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import numbered, place_of

RESOLUTION = 1 << 48
#: Blocks of a schedule that is broadcast; a longer one is joined by a shuffle.
MOST_BROADCAST = 200_000
BLOCK_BYTES = 65_536
#: Documents of a chunk: offsets are summed within a chunk, and chunks' totals within a source.
CHUNK_DOCS = 4_000


def quotas(weights: dict[str, float], resolution: int = RESOLUTION) -> dict[str, int]:
    """Parts of resolution for each source, by largest remainder; at least one, so the sum is greater if sources have less."""
    total = sum(weights.values())
    if any(not w > 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    exact = {s: w / total * resolution for s, w in weights.items()}
    slots = {s: max(1, math.floor(x)) for s, x in exact.items()}
    left = max(0, resolution - sum(slots.values()))
    for s in sorted(exact, key=lambda s: (slots[s] - exact[s], s))[:left]:
        slots[s] += 1
    return slots


def schedule(slots: dict[str, int], blocks: dict[str, int]) -> Iterator[tuple[str, int, int, int, int]]:
    """(source, block, slot, release, deadline) of so many blocks of each source, its weight being its part of all slots.

    Earliest deadline first among the released blocks; ties by source. Slots in which no block is released stay empty.
    """
    length, t = sum(slots.values()), 0
    waiting = [(0, -(-length // slots[s]), s, 0) for s, n in blocks.items() if n]
    heapq.heapify(waiting)
    released: list[tuple[int, str, int, int]] = []
    while waiting or released:
        if not released:
            t = max(t, waiting[0][0])
        while waiting and waiting[0][0] <= t:
            release, deadline, s, i = heapq.heappop(waiting)
            heapq.heappush(released, (deadline, s, i, release))
        deadline, s, i, release = heapq.heappop(released)
        yield s, i, t, release, deadline
        t += 1
        if i + 1 < blocks[s]:
            heapq.heappush(waiting, ((i + 1) * length // slots[s], -(-(i + 2) * length // slots[s]), s, i + 1))


def cycle(slots: dict[str, int]) -> list[tuple[str, int]]:
    """(source, block) of every slot until all sources have had their slots."""
    return [(s, i) for s, i, *_ in schedule(slots, slots)]


def tempered(sizes: dict[str, float], power: float = 0.5) -> dict[str, float]:
    """Weights in proportion to a power of the sources' sizes."""
    return {s: max(float(x), 1.0) ** power for s, x in sizes.items()}


def _table(spark: SparkSession, slots: dict[str, int], blocks: dict[str, int]) -> DataFrame:
    """The schedule as a table, broadcast if it is short."""
    sources = sorted(blocks)
    place, total = {s: k for k, s in enumerate(sources)}, sum(blocks.values())
    # columns of numbers, not tuples: the driver holds 40 bytes a block
    columns = np.empty((5, total), dtype=np.int64)
    for n, (s, *numbers) in enumerate(schedule(slots, blocks)):
        columns[:, n] = (place[s], *numbers)
    names = ["_block", "_slot", "_release", "_deadline"]
    owner = pa.array(sources, pa.string()).take(pa.array(columns[0]))
    table = spark.createDataFrame(pa.table({"_source": owner, **{n: pa.array(c) for n, c in zip(names, columns[1:], strict=True)}}))
    return F.broadcast(table) if total <= MOST_BROADCAST else table


ADDED = ("_source", "_bytes", "_start", "_block", "_slot", "_release", "_deadline")


def mixed_blocks(docs: DataFrame, weights: dict[str, float] | None = None, source: str = "source", id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, power: float = 0.5, resolution: int = RESOLUTION) -> DataFrame:
    """docs with its columns named c0, c1, ... and ADDED after them; _start is the bytes of its source before it.

    Without weights, a source's is its bytes to the given power; a source that weights doesn't name gets the least of them.
    The null source is a source of its own (''). Null and empty texts have no bytes and ride with their neighbours. Repeated
    rows each have a place. An empty table stays empty.
    """
    own, body, by = place_of(docs, id), place_of(docs, text), place_of(docs, source)
    size = F.coalesce(F.octet_length(body), F.lit(0)).cast("long")
    given = numbered(docs).withColumns({"_source": F.coalesce(F.col(by).cast("string"), F.lit("")), "_bytes": size, "_tie": F.xxhash64(own, body)})
    rows = docs.count()
    chunks = max(1, math.ceil(rows / CHUNK_DOCS))
    given = given.withColumn("_chunk", F.pmod(F.xxhash64("_tie"), F.lit(chunks)))
    totals = given.groupBy("_source", "_chunk").agg(F.sum("_bytes").alias("_sum"))
    sizes = {r["_source"]: r["n"] for r in totals.groupBy("_source").agg(F.sum("_sum").alias("n")).collect()}
    if weights is None:
        wanted = tempered(sizes, power)
    else:
        wanted = {s: weights.get(s, min(weights.values())) for s in sizes}
    table = _table(docs.sparkSession, quotas(wanted, resolution) if sizes else {}, {s: n // block_bytes + 1 for s, n in sizes.items()})
    before = totals.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.partitionBy("_source").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_source", "_chunk", "_before")
    inside = F.coalesce(F.sum("_bytes").over(Window.partitionBy("_source", "_chunk").orderBy("_tie", own).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = given.withColumn("_inside", inside).join(before, ["_source", "_chunk"]).withColumn("_start", F.col("_before") + F.col("_inside"))
    cut = placed.withColumn("_block", F.floor(F.col("_start") / block_bytes))
    # a zero-byte document at the very end of a block boundary opens a block of its own, which is as good a place as any
    return cut.join(table, ["_source", "_block"]).select(*numbered(docs).columns, *ADDED)


def mixed_order(docs: DataFrame, **options) -> DataFrame:
    """docs, same rows and columns, written in the order of the mix: by ranges of slots, sorted within."""
    ordered = mixed_blocks(docs, **options)
    return ordered.repartitionByRange("_slot", "_start").sortWithinPartitions("_slot", "_start").drop(*ADDED).toDF(*docs.columns)


def op7_pfair(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    names = ["source", "n_bytes", "start", "block", "slot", "release", "deadline"]
    return mixed_blocks(docs).select(F.col("c0").alias("doc_id"), *[F.col(own).alias(name) for own, name in zip(ADDED, names, strict=True)])
