"""Exact top-k by inner product with vector-approximation files.

Vectors count as integers floor(scale * x). A VA-file is written once for a table: for each block of rows, one byte for every
component (its cell on a uniform grid between the block's smallest and largest value), and beside it the exact vectors, each
under a row number. A cell bounds the component, and so bounds the inner product with a query on both sides.

1. Blocks of queries scan groups of blocks of cells; only cells move. A group carries each query's k-th best lower bound from
   block to block and gives back the rows whose upper bound reaches it.
2. The k-th best lower bound over all groups drops most of these. The rest are read, exact vectors fetched by row number, in
   the order of their upper bounds: first 2 k a query, whose k-th exact score then tells which of the others still have to be.

Bounds are computed in floating point with its rounding added to them; scores are exact integers, whatever the components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import picked, written

SCALE = 1024
#: Queries of a block; cells of a block of rows; blocks of rows that a group scans one after the other.
QUERY_BLOCK, BLOCK_CELLS, GROUP_BLOCKS = 2048, 1 << 20, 32
#: Queries bounded at a time inside a task.
SCAN = 128
#: Cells of a component.
CELLS = 256
#: Magnitude below which sums of integer products are exact in float64.
EXACT = float(1 << 53)
#: Largest and smallest score, those of a long.
MOST, LEAST = (1 << 63) - 1, -(1 << 63)


@dataclass
class VaFile:
    """The written tables: rows (rid, vec_id, v) and cells (one row for each block)."""

    rows: DataFrame
    cells: DataFrame
    n_rows: int
    n_blocks: int


def integer_vectors(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id and v, the vectors' floor(scale * x) / scale; vectors that are null, empty or hold a null or non-finite component go,
    as do those of a null id. scale is a power of two, so v is exact. Other columns, also of like names, play no part."""
    if scale & (scale - 1) or scale < 1:
        raise ValueError("scale must be a power of two")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    # a double of 2^53 / scale or more is a multiple of 1 / scale already
    whole = lambda x: F.when(F.abs(x) < EXACT / scale, F.floor(x * F.lit(float(scale))).cast("double") / F.lit(float(scale))).otherwise(x)
    given = picked(vectors, vec_id=id, x=vector).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("x").cast("array<double>").alias("x"))
    return given.filter(F.col("vec_id").isNotNull() & (F.size("x") > 0) & ~F.exists("x", bad)).select("vec_id", F.transform("x", whole).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _taken(held: list[pa.RecordBatch], of: int) -> tuple[pa.Table, list[pa.RecordBatch]]:
    """The first `of` rows of the batches, and the rest."""
    table = pa.Table.from_batches(held)
    return table.slice(0, of), table.slice(of).to_batches()


def _by_length(batches: Iterator[pa.RecordBatch], rows_of) -> Iterator[tuple[int, pa.Table]]:
    """(d, rows) of vectors with d components each, at most rows_of(d) of them."""
    held: dict[int, list[pa.RecordBatch]] = {}
    for batch in batches:
        lengths = pc.list_value_length(batch.column("v"))
        for d in pc.unique(lengths).to_pylist():
            own = held.setdefault(d, [])
            own.append(batch.filter(pc.equal(lengths, d)))
            while sum(b.num_rows for b in own) >= rows_of(d):
                table, own[:] = _taken(own, rows_of(d))
                yield d, table
    for d, own in held.items():
        if any(b.num_rows for b in own):
            yield d, pa.Table.from_batches(own)


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cells, low, width, least, most): a component lies between low + cell * width + least and ... + most, rounding included."""
    with np.errstate(all="ignore"):
        low = vectors.min(axis=0)
        width = vectors.max(axis=0) / CELLS - low / CELLS
        width = np.where(width > 0, width, 1.0)
        cells = np.clip(np.nan_to_num(np.floor(vectors / width - low / width)), 0, CELLS - 1).astype(np.uint8)
        off = vectors - (low + cells * width)
        slack = (np.abs(low) + CELLS * width) * 2.0**-50
        return cells, low, width, off.min(axis=0) - slack, off.max(axis=0) + slack


def _places(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """For each row how many smaller ids have the same vector, -1 if an earlier row has the same id and vector."""
    same = np.unique(np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.shape[1] * 8))).ravel(), return_inverse=True)[1].ravel()
    order = np.lexsort((ids, same))
    new = np.concatenate(([True], same[order][1:] != same[order][:-1]))
    again = np.concatenate(([False], ~new[1:] & (ids[order][1:] == ids[order][:-1])))
    distinct = np.cumsum(~again) - 1
    place = distinct - np.maximum.accumulate(np.where(new, distinct, 0))
    out = np.empty(len(ids), dtype=np.int64)
    out[order] = np.where(again, -1, place)
    return out


BLOCKS = "block long, d int, rids binary, ids binary, places binary, grid binary, cells binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for d, table in _by_length(batches, lambda d: max(1, BLOCK_CELLS // d)):
        # minus zero becomes zero, so that equal vectors have equal bytes
        vectors, ids, rids = _matrix(table.column("v")) + 0.0, table.column("vec_id").to_numpy(), table.column("rid").to_numpy()
        cells, *grid = quantised(vectors)
        packed = [rids.tobytes(), ids.tobytes(), _places(ids, vectors).tobytes(), np.concatenate(grid).tobytes(), cells.tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([int(rids[0])]), pa.array([d], pa.int32()), *[pa.array([x], pa.binary()) for x in packed]], ["block", "d", "rids", "ids", "places", "grid", "cells"])


def build(vectors: DataFrame) -> VaFile:
    """The VA-file of a table of (vec_id, v); two tables in the shared folder."""
    rows = written(vectors.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "v"), "vectors")
    n = rows.count()
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 1
    # whole blocks need no more tasks than there are blocks
    cells = written(rows.coalesce(max(1, math.ceil(n * longest / BLOCK_CELLS))).mapInArrow(_blocks, BLOCKS), "cells")
    return VaFile(rows, cells, n, cells.count())


QUERIES = "block long, d int, qrids binary, ids binary, v binary"


def _query_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for d, table in _by_length(batches, lambda d: QUERY_BLOCK):
        qrids = table.column("qrid").to_numpy()
        packed = [qrids.tobytes(), table.column("query_id").to_numpy().tobytes(), _matrix(table.column("v")).tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([int(qrids[0])]), pa.array([d], pa.int32()), *[pa.array([x], pa.binary()) for x in packed]], ["block", "d", "qrids", "ids", "v"])


class _Bounds:
    """One block's cells against queries: bound = scale * cells @ weights + base, less or more by what the query alone tells."""

    def __init__(self, row: dict, k: int):
        d = row["d"]
        keep = (places := np.frombuffer(row["places"], dtype=np.int64)) <= k
        keep &= places >= 0  # of equal vectors only the k + 1 smallest ids can be among a query's k best
        self.rids, self.ids = (np.frombuffer(row[c], dtype=np.int64)[keep] for c in ("rids", "ids"))
        self.cells = np.frombuffer(row["cells"], dtype=np.uint8).reshape(-1, d)[keep].astype(np.float32)
        self.low, self.width, self.least, self.most = np.frombuffer(row["grid"], dtype=np.float64).reshape(4, d)
        self.distinct, self.group = np.unique(self.ids, return_inverse=True)
        self.repeated = len(self.distinct) < len(self.ids)

    def of(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sums, down, up): a row's inner product lies between sums - down and sums + up; infinite where that can't be told."""
        d = queries.shape[1]
        with np.errstate(all="ignore"):
            weights = queries * self.width
            scale = np.abs(weights).max(axis=1, keepdims=True)
            scale = np.where(scale > 0, scale, 1.0)
            single = (weights / scale).astype(np.float32)
            sums = (single @ self.cells.T).astype(np.float64) * scale + (queries @ self.low)[:, None]
            size = np.abs(queries) @ (np.abs(self.low) + CELLS * self.width)
            error = scale[:, 0] * ((d + 4) * 2.0**-23 * CELLS) * np.abs(single).sum(axis=1, dtype=np.float64) + (d + 8) * 2.0**-51 * size
            up = np.maximum(queries * self.least, queries * self.most).sum(axis=1) + error
            down = error - np.minimum(queries * self.least, queries * self.most).sum(axis=1)
            lost = ~(np.isfinite(up) & np.isfinite(down) & np.isfinite(sums).all(axis=1))
            sums[lost], up[lost], down[lost] = 0.0, np.inf, np.inf
        return sums, down, up


CANDIDATES = "qrid long, query_id long, rid long, vec_id long, lower double, upper double"
_CANDIDATES = pa.schema([(n, pa.int64()) for n in ("qrid", "query_id", "rid", "vec_id")] + [("lower", pa.float64()), ("upper", pa.float64())])


class _Best:
    """What a query block has found so far: candidate rows with their bounds, and each query's k-th best lower bound."""

    def __init__(self, row: dict, k: int, limit: float):
        self.qrids, self.ids = (np.frombuffer(row[c], dtype=np.int64) for c in ("qrids", "ids"))
        self.v = np.frombuffer(row["v"], dtype=np.float64).reshape(len(self.ids), row["d"])
        self.k, self.limit = k, limit
        self.kth = np.full(len(self.ids), -np.inf)
        none = np.zeros(0, np.int64)
        self.found = [(none, none, np.zeros(0), np.zeros(0))] * len(self.ids)  # rids, ids, lower and upper bounds

    def scan(self, block: _Bounds) -> None:
        for at in range(0, len(self.ids), SCAN):
            part = slice(at, at + SCAN)
            sums, down, up = block.of(self.v[part])
            own = block.ids[None, :] == self.ids[part, None]
            lower, upper = np.clip(sums - down[:, None], -self.limit, self.limit), np.clip(sums + up[:, None], -self.limit, self.limit)
            lower[own] = upper[own] = -np.inf
            floor = self.kth[part].copy()
            fresh = np.flatnonzero(np.isneginf(floor))
            if len(fresh) and len(block.distinct) > self.k:
                best = lower[fresh]
                if block.repeated:
                    order = np.argsort(block.group, kind="stable")
                    best = np.maximum.reduceat(best[:, order], np.flatnonzero(np.diff(block.group[order], prepend=-1)), axis=1)
                floor[fresh] = np.partition(best, best.shape[1] - self.k, axis=1)[:, best.shape[1] - self.k]
            which, where = np.nonzero((upper >= floor[:, None]) & ~own)
            ends = np.searchsorted(which, np.arange(len(floor) + 1))
            for i in np.unique(which).tolist():
                here = where[ends[i] : ends[i + 1]]
                self._add(at + i, block.rids[here], block.ids[here], lower[i, here], upper[i, here])

    def _add(self, i: int, rids: np.ndarray, ids: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> None:
        rids, ids, lower, upper = (np.concatenate(x) for x in zip(self.found[i], (rids, ids, lower, upper), strict=True))
        order = np.lexsort((-lower, ids))
        best = lower[order][np.diff(ids[order], prepend=ids[order][0] - 1) != 0]  # of each id
        if len(best) >= self.k:
            self.kth[i] = max(self.kth[i], np.partition(best, len(best) - self.k)[len(best) - self.k])
            near = upper >= self.kth[i]
            rids, ids, lower, upper = rids[near], ids[near], lower[near], upper[near]
        self.found[i] = (rids, ids, lower, upper)

    def rows(self) -> pa.Table:
        sizes = np.array([len(f[0]) for f in self.found])
        columns = [np.repeat(x, sizes) for x in (self.qrids, self.ids)] + [np.concatenate(c) for c in zip(*self.found, strict=True)]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, _CANDIDATES, strict=True)], schema=_CANDIDATES)


def _scanner(k: int, limit: float):
    def scanned(queries: pa.Table, cells: pa.Table) -> pa.Table:
        best = [_Best(row, k, limit) for row in queries.to_pylist()]
        for at in range(cells.num_rows if best else 0):
            block = _Bounds(cells.slice(at, 1).to_pylist()[0], k)
            for b in best:
                b.scan(block)
        return pa.concat_tables([b.rows() for b in best]) if best else _CANDIDATES.empty_table()

    return scanned


def exact_scores(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Row by row the inner product of the integers scale * a and scale * b, cut to the range of a long."""
    with np.errstate(all="ignore"):
        x, y = a * scale, b * scale
        size = (np.abs(x) * np.abs(y)).sum(axis=1)
        small = size < EXACT
        out = np.zeros(len(a), dtype=np.int64)
        out[small] = (x[small] * y[small]).sum(axis=1).astype(np.int64)
    whole = lambda v: int(v * scale) if abs(v) < 2.0**900 else int(v) * scale
    for i in np.flatnonzero(~small).tolist():
        total = sum(whole(p) * whole(q) for p, q in zip(a[i].tolist(), b[i].tolist(), strict=True))
        out[i] = min(MOST, max(LEAST, total))
    return out


def _reader(scale: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d in pc.unique(pc.list_value_length(batch.column("v"))).to_pylist():
                own = batch.filter(pc.equal(pc.list_value_length(batch.column("v")), d))
                score = exact_scores(_matrix(own.column("v")), _matrix(own.column("q")), scale)
                yield pa.RecordBatch.from_arrays([own.column("query_id"), own.column("vec_id"), pa.array(score)], ["query_id", "vec_id", "score"])

    return read


def search(file: VaFile, queries: DataFrame, k: int = 10, scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query's k highest scores among all vectors but its own id's.

    queries hold vec_id and v. Only vectors of the queries' length meet: vectors of another length are skipped. Rows that
    share an id count as one vector, with the best score of any of them, on both sides. Scores beyond a long are its largest
    or smallest value, and tie. Without vectors or queries there are no rows.
    """
    limit = 2.0**63 / scale / scale
    asked = written(queries.select(F.monotonically_increasing_id().alias("qrid"), F.col("vec_id").alias("query_id"), "v"), "queries")
    slots = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    groups = max(1, math.ceil(file.n_blocks / GROUP_BLOCKS))
    hashed = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    blocks = asked.coalesce(slots).mapInArrow(_query_blocks, QUERIES).withColumn("slot", hashed(slots)).withColumn("part", every(groups))
    cells = file.cells.withColumn("part", hashed(groups)).withColumn("slot", every(slots))
    key = ["slot", "part", "d"]
    found = written(blocks.groupBy(*key).cogroup(cells.groupBy(*key)).applyInArrow(_scanner(k, limit), CANDIDATES), "candidates")

    by_query = Window.partitionBy("query_id")
    kth = lambda df, by: df.withColumn("_n", F.row_number().over(by_query.orderBy(F.desc(by)))).filter(F.col("_n") == k).select("query_id", F.col(by).alias("kth"))
    bound = kth(found.groupBy("query_id", "vec_id").agg(F.max("lower").alias("lower")), "lower")
    near = found.join(bound, "query_id", "left").filter("kth IS NULL OR upper >= kth").drop("kth", "lower")
    near = written(near.withColumn("turn", F.row_number().over(by_query.orderBy(F.desc("upper"), "vec_id", "rid", "qrid"))), "near")

    def read(pairs: DataFrame) -> DataFrame:
        given = asked.select("qrid", F.col("v").alias("q"))
        return pairs.select("qrid", "query_id", "rid").join(file.rows, "rid").join(given, "qrid").select("query_id", "vec_id", "v", "q").mapInArrow(_reader(scale), "query_id long, vec_id long, score long").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))

    first = written(read(near.filter(F.col("turn") <= 2 * k)), "scores")
    certain = kth(first, "score")
    others = near.filter(F.col("turn") > 2 * k).join(certain, "query_id", "left").filter(F.col("kth").isNull() | (F.col("upper") * float(scale * scale) >= F.col("kth")))
    scores = first.union(read(others)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(by_query.orderBy(F.desc("score"), "vec_id"))
    return scores.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = SCALE) -> DataFrame:
    """search() in a VA-file made of vectors (vec_id, v)."""
    return search(build(vectors), queries, k, scale)


def op8_vector_approximation(spark, sf_dir: str) -> DataFrame:
    file = build(integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
    return search(file, file.rows.filter(F.col("vec_id") % 100 == 0))


ORACLE = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
