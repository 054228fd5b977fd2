"""Hard negatives by bit-sliced integer products.

Vectors count as integers floor(scale * x). A block of rows keeps, beside each component's smallest value, the bit-planes of what
its components have above it. An anchor's product with a row is then a sum over planes, and after the planes down to bit j each
component still misses between 0 and 2^j - 1: the score lies in an interval that halves with every plane. Planes are processed
most significant first; a row is dropped when its interval can't reach what is asked, or when enough certain rows lie above it.

Two passes of the same scan, in blocks of anchors and groups of blocks of rows: the first finds each anchor's positives, its
best other rows of the same label; the second, given their scores, the best rows of other labels whose score is at most the
positive's and at least a share of it. Only packed planes move. A group carries each question's k-th best score from block to
block and gives back k rows for each at most; ranks over all groups follow by a window.

Products are exact: in float64 while they stay below 2^45, else (huge components, very long vectors) in Python's integers by
the same steps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import picked, written

SCALE = 256
POSITIVES, NEGATIVES = 5, 5
#: Share of the positive's score that a negative has at least, in percent.
PERCENT = 80
#: Anchors of a block; components of a block of rows; blocks of rows that a group scans one after the other.
ANCHOR_BLOCK, BLOCK_CELLS, GROUP_BLOCKS = 2048, 1 << 18, 4
#: Anchors scanned at a time inside a task.
SCAN = 128
#: Components below this, in vectors of at most so many, have products below 2^45, a hundredfold of which float64 holds.
NARROW, NARROW_LENGTH = 1 << 17, 2048
#: Share of pairs left from which planes are read pair by pair.
SPARSE = 1 / 16
#: Largest and smallest score, those of a long.
MOST, LEAST = (1 << 63) - 1, -(1 << 63)


def labelled_vectors(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE) -> DataFrame:
    """vec_id, label, v (the vector's floor(scale * x) / scale, exact as scale is a power of two) and wide (whether its products
    may leave float64). Rows of a null id or label go, and vectors that are null, empty or hold a null or non-finite component."""
    if scale & (scale - 1) or scale < 1:
        raise ValueError("scale must be a power of two")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    # a double of 2^53 / scale or more is a multiple of 1 / scale already
    whole = lambda x: F.when(F.abs(x) < 2.0**53 / scale, F.floor(x * F.lit(float(scale))).cast("double") / F.lit(float(scale))).otherwise(x)
    given = picked(vectors, vec_id=id, x=vector, label=label).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("x").cast("array<double>").alias("x"))
    kept = given.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("x") > 0) & ~F.exists("x", bad))
    wide = (F.size("v") > NARROW_LENGTH) | F.exists("v", lambda x: F.abs(x) * scale >= NARROW)
    return kept.select("vec_id", "label", F.transform("x", whole).alias("v")).withColumn("wide", wide)


def _integers(v: np.ndarray, scale: int, wide: bool) -> np.ndarray:
    """scale * v as whole numbers: int64, or Python's if wide."""
    if not wide:
        return (v * scale).astype(np.int64)
    out = np.empty(v.shape, dtype=object)
    out.ravel()[:] = [int(x * scale) if abs(x) < 2.0**900 else int(x) * scale for x in v.ravel().tolist()]
    return out


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _alike(batches: Iterator[pa.RecordBatch], rows_of) -> Iterator[tuple[int, bool, pa.Table]]:
    """(d, wide, rows): rows of one length and kind, at most rows_of(d) of them."""
    held: dict[tuple[int, bool], list[pa.RecordBatch]] = {}
    for batch in batches:
        kinds = pc.list_value_length(batch.column("v")), batch.column("wide")
        for key in {(d, w) for d, w in zip(*(k.to_pylist() for k in kinds), strict=True)}:
            own = held.setdefault(key, [])
            own.append(batch.filter(pc.and_(pc.equal(kinds[0], key[0]), pc.equal(kinds[1], key[1]))))
            while sum(b.num_rows for b in own) >= rows_of(key[0]):
                table = pa.Table.from_batches(own)
                own[:] = table.slice(rows_of(key[0])).to_batches()
                yield *key, table.slice(0, rows_of(key[0]))
    for key, own in held.items():
        if any(b.num_rows for b in own):
            yield *key, pa.Table.from_batches(own)


PLANES = "block long, d int, wide boolean, ids binary, labels binary, base string, planes int, bits binary"


def _sliced(scale: int, most: int):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of rows by label and id. Of rows of one label and vector only those of the most + 1 smallest ids (and most of
        each id) can be asked for, ties going to the smaller id; the others aren't kept."""
        for d, wide, table in _alike(batches, lambda d: max(1, BLOCK_CELLS // d)):
            v, ids, labels = _matrix(table.column("v")) + 0.0, table.column("vec_id").to_numpy(), table.column("label").to_numpy()
            same = np.unique(np.ascontiguousarray(np.column_stack((v, labels.view(np.float64)))).view(np.dtype((np.void, (d + 1) * 8))).ravel(), return_inverse=True)[1].ravel()
            order = np.lexsort((ids, same))
            new = np.diff(same[order], prepend=-1) != 0
            fresh = new | (np.diff(ids[order], prepend=0) != 0)
            number = np.cumsum(fresh) - 1  # of the (vector, id), within the block
            rank = number - np.maximum.accumulate(np.where(new, number, 0))
            at = np.arange(len(order))
            again = at - np.maximum.accumulate(np.where(fresh, at, 0))
            keep = order[(rank <= most) & (again < most)]
            keep = keep[np.lexsort((ids[keep], labels[keep]))]
            x = _integers(v[keep], scale, wide)
            base = x.min(axis=0)
            above = x - base
            planes = int(above.max()).bit_length()
            bits = [np.packbits(((above >> j) & 1).astype(np.uint8)).tobytes() for j in range(planes - 1, -1, -1)]
            columns = [int(table.column("rid")[0].as_py()), d, wide, ids[keep].tobytes(), labels[keep].tobytes(), ",".join(map(str, base.tolist())), planes, b"".join(bits)]
            kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.string(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(columns, kinds, strict=True)], ["block", "d", "wide", "ids", "labels", "base", "planes", "bits"])

    return blocks


class _Block:
    def __init__(self, row: dict):
        self.d, self.wide, self.planes = row["d"], row["wide"], row["planes"]
        self.ids, self.labels = (np.frombuffer(row[c], dtype=np.int64) for c in ("ids", "labels"))
        self.base = np.array([int(x) for x in row["base"].split(",")], dtype=object)
        self.bits, self.size = np.frombuffer(row["bits"], dtype=np.uint8), -(-len(self.ids) * self.d // 8)

    def plane(self, n: int, rows: slice) -> np.ndarray:
        """The n-th plane from the most significant on, of some rows: their bits."""
        packed = self.bits[n * self.size : (n + 1) * self.size]
        return np.unpackbits(packed, count=len(self.ids) * self.d).reshape(-1, self.d)[rows]


def _best_of(a: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of each a's k highest scores, ties to smaller ids; by a, best first."""
    order = np.argsort(ids, kind="stable")
    order = order[np.argsort(~scores[order], kind="stable")]  # (unlike a minus, this holds for the smallest long too)
    order = order[np.argsort(a[order], kind="stable")]
    at = np.arange(len(order))
    heads = np.maximum.accumulate(np.where(np.diff(a[order], prepend=-1) != 0, at, 0))
    return order[at - heads < k]


class _Questions:
    """A block of anchors; of each, up to m questions: the k best rows with a score from low to high. What is found so far."""

    def __init__(self, row: dict, k: int, scale: int, other: bool):
        self.rids, self.ids, self.labels = (np.frombuffer(row[c], dtype=np.int64) for c in ("rids", "ids", "labels"))
        self.k, self.other, n = k, other, len(self.ids)
        v = np.frombuffer(row["v"], dtype=np.float64).reshape(n, row["d"])
        self.wide, self.x = row["wide"], _integers(v, scale, row["wide"])
        self.m = m = row["m"]
        if other:  # a share of the positive's score to that score; none where there are fewer positives
            self.high = np.frombuffer(row["high"], dtype=np.int64).reshape(n, m).astype(object)
            self.low = np.where(np.frombuffer(row["asked"], dtype=bool).reshape(n, m), -((-row["percent"] * self.high) // 100), np.inf)
        else:
            self.high, self.low = np.full((n, m), np.inf, dtype=object), np.full((n, m), -np.inf, dtype=object)
        self.floor = np.full((n, m), -np.inf, dtype=object)
        none = np.zeros(0, dtype=np.int64)
        self.found = [[(none, none, none)] for _ in range(m)]  # anchors, ids, scores by question

    def scan(self, block: _Block) -> None:
        for label in [None] if self.other else np.intersect1d(block.labels, self.labels).tolist():
            mine = np.arange(len(self.ids)) if label is None else np.flatnonzero(self.labels == label)
            rows = slice(0, len(block.ids)) if label is None else slice(*np.searchsorted(block.labels, [label, label + 1]).tolist())
            for at in range(0, len(mine), SCAN):
                self._part(block, mine[at : at + SCAN], rows)
        for p in range(self.m):
            self._tidy(p)

    def _part(self, block: _Block, mine: np.ndarray, rows: slice) -> None:
        """Anchors and rows whose intervals start as wide as the block's planes allow and are tightened plane by plane."""
        exact = object if block.wide or self.wide else np.float64
        q = self.x[mine].astype(exact)
        ids = block.ids[rows]
        alive = ids[None, :] != self.ids[mine][:, None]
        if self.other:
            alive &= block.labels[rows][None, :] != self.labels[mine][:, None]
        up, down = np.maximum(q, 0).sum(axis=1), np.minimum(q, 0).sum(axis=1)
        a, r = np.nonzero(alive)
        sums = (q * block.base.astype(exact)).sum(axis=1)[a]
        low, high, floor = (x[mine].astype(exact) for x in (self.low, self.high, self.floor))
        for n in range(block.planes + 1):
            if n:
                bit, plane = block.planes - n, block.plane(n - 1, rows)
                if exact is np.float64 and len(a) > SPARSE * alive.size:
                    more = (q @ plane.T.astype(exact))[a, r]
                else:
                    more = _products(q, plane, a, r, exact)
                sums = sums + more * exact(1 << bit) if exact is np.float64 else sums + more * (1 << bit)
            left = (1 << (block.planes - n)) - 1
            lower, upper = sums + down[a] * left, sums + up[a] * left
            if exact is object:
                lower, upper = (np.minimum(np.maximum(x, LEAST), MOST) for x in (lower, upper))
            keep = np.zeros(len(a), dtype=bool)
            for p in range(self.m):
                possible = (upper >= low[a, p]) & (lower <= high[a, p])
                if left and n:  # enough certain rows above drop the others
                    certain = np.flatnonzero(possible & (lower >= low[a, p]) & (upper <= high[a, p]) & (lower >= floor[a, p]))
                    floor[:, p] = _raised(floor[:, p], a[certain], lower[certain], self.k)
                keep |= possible & (upper >= floor[a, p])
            if not keep.all():
                a, r, sums = a[keep], r[keep], sums[keep]
            if not len(a):
                return
        scores = sums.astype(np.int64) if exact is np.float64 else np.minimum(np.maximum(sums, LEAST), MOST)
        for p in range(self.m):
            fit = (scores >= self.low[mine][a, p]) & (scores <= self.high[mine][a, p])
            self.found[p].append((mine[a[fit]], ids[r[fit]], scores[fit].astype(np.int64)))

    def _tidy(self, p: int) -> None:
        """Keeps the k best of each anchor, whose k-th score is a floor for the blocks to come."""
        a, ids, scores = (np.concatenate(c) for c in zip(*self.found[p], strict=True))
        best = _best_of(a, ids, scores, self.k)
        self.found[p] = [(a := a[best], ids[best], scores := scores[best])]
        heads = np.flatnonzero(np.diff(a, prepend=-1) != 0)
        full = heads[np.diff(np.append(heads, len(a))) == self.k]
        self.floor[a[full], p] = scores[full + self.k - 1].tolist()

    def rows(self) -> list[np.ndarray]:
        """rid, question, id and score of all that is found."""
        parts = [(self.rids[a], np.full(len(a), p), ids, scores) for p in range(self.m) for a, ids, scores in self.found[p]]
        return [np.concatenate(c) for c in zip(*parts, strict=True)]


def _products(q: np.ndarray, plane: np.ndarray, a: np.ndarray, r: np.ndarray, exact) -> np.ndarray:
    """Products of pairs, so many at a time."""
    out, size = np.empty(len(a), dtype=exact), max(1, (1 << 22) // plane.shape[1])
    for at in range(0, len(a), size):
        part = slice(at, at + size)
        bits = plane[r[part]]
        out[part] = np.einsum("ij,ij->i", q[a[part]], bits.astype(exact)) if exact is np.float64 else np.where(bits, q[a[part]], 0).sum(axis=1)
    return out


def _raised(floor: np.ndarray, a: np.ndarray, lower: np.ndarray, k: int) -> np.ndarray:
    """Each anchor's k-th best lower bound, where it is better than the floor."""
    sizes = np.bincount(a, minlength=len(floor))  # pairs come by anchor
    ends = np.cumsum(sizes)
    out = floor.copy()
    for i in np.flatnonzero(sizes >= k).tolist():
        own = lower[ends[i] - sizes[i] : ends[i]]
        kth = np.partition(own, len(own) - k)[len(own) - k] if own.dtype != object else sorted(own.tolist())[-k]
        out[i] = max(out[i], kth)
    return out


QUESTIONS = "block long, d int, wide boolean, rids binary, ids binary, labels binary, v binary, m int, percent int, high binary, asked binary"


def _asked(percent: int, m: int):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, wide, table in _alike(batches, lambda d: max(1, min(ANCHOR_BLOCK, (ANCHOR_BLOCK * 64) // d))):
            packed = [table.column(c).to_numpy().tobytes() for c in ("rid", "vec_id", "label")] + [_matrix(table.column("v")).tobytes()]
            highs = table.column("scores").to_pylist()
            high, asked = np.zeros((len(highs), m), dtype=np.int64), np.zeros((len(highs), m), dtype=bool)
            for i, own in enumerate(highs):
                high[i, : len(own)], asked[i, : len(own)] = own, True
            row = [int(table.column("rid")[0].as_py()), d, wide, *packed, m, percent, high.tobytes(), asked.tobytes()]
            kinds = (pa.int64(), pa.int32(), pa.bool_(), *[pa.binary()] * 4, pa.int32(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, kinds, strict=True)], ["block", "d", "wide", "rids", "ids", "labels", "v", "m", "percent", "high", "asked"])

    return blocks


BEST = "rid long, question int, vec_id long, score long"
_BEST = pa.schema([("rid", pa.int64()), ("question", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _scanner(k: int, scale: int, other: bool):
    def scanned(anchors: pa.Table, planes: pa.Table) -> pa.Table:
        asked = [_Questions(row, k, scale, other) for row in anchors.to_pylist()]
        for at in range(planes.num_rows if asked else 0):
            block = _Block(planes.slice(at, 1).to_pylist()[0])
            for q in asked:
                q.scan(block)
        columns = [np.concatenate(c) for c in zip(*[q.rows() for q in asked], strict=True)] if asked else [[]] * 4
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, _BEST, strict=True)], schema=_BEST)

    return scanned


def _scan(anchors: DataFrame, planes: DataFrame, slots: int, groups: int, k: int, m: int, scale: int, other: bool, percent: int) -> DataFrame:
    """rid, question, vec_id and score of the k best rows in each group of blocks of rows."""
    hashed = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    blocks = anchors.coalesce(slots).mapInArrow(_asked(percent, m), QUESTIONS).withColumn("slot", hashed(slots)).withColumn("part", every(groups))
    rows = planes.withColumn("part", hashed(groups)).withColumn("slot", every(slots))
    key = ["slot", "part", "d"]
    return blocks.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(_scanner(k, scale, other), BEST)


def _ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, percent: int = PERCENT, scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    vectors are labelled_vectors(); is_anchor is a condition on them. An anchor's positives are its best other rows of the same
    label, a positive's negatives the best rows of other labels with percent * positive <= 100 * score <= 100 * positive; ties go
    to smaller ids. A negative positive score has none. Rows of the anchor's own id are never its candidates; other repeated rows,
    also of one id, each count, and a repeated anchor is asked each time. Only vectors of one length meet. Scores beyond a long
    are its largest or smallest value. Without anchors or candidates there are no rows.
    """
    numbers = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    n_blocks = max(1, math.ceil(numbers["n"] * (numbers["d"] or 1) / BLOCK_CELLS))
    most = max(positives, negatives)
    numbered = vectors.withColumn("rid", F.monotonically_increasing_id())
    planes = written(numbered.coalesce(n_blocks).mapInArrow(_sliced(scale, most), PLANES), "planes")
    groups = max(1, math.ceil(planes.count() / GROUP_BLOCKS))
    anchors = written(numbered.filter(is_anchor).select("rid", "vec_id", "label", "v", "wide"), "anchors")
    slots = max(1, math.ceil(anchors.count() / ANCHOR_BLOCK))
    best = _scan(anchors.withColumn("scores", F.array(F.lit(0).cast("long"))), planes, slots, groups, positives, 1, scale, False, percent)
    lists = _ranked(best, ["rid"], positives).groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("best"))
    told = written(anchors.join(lists, "rid").select("rid", "vec_id", "label", "v", "wide", "best", F.col("best.score").alias("scores")), "positives")
    found = _scan(told.select("rid", "vec_id", "label", "v", "wide", "scores"), planes, slots, groups, negatives, positives, scale, True, percent)
    ranked = _ranked(found, ["rid", "question"], negatives).withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
    names = told.select("rid", F.col("vec_id").alias("anchor_id"), F.posexplode("best").alias("question", "b")).select("rid", "anchor_id", "question", F.col("b.vec_id").alias("positive_id"), F.col("b.score").alias("positive_score"))
    return ranked.join(names, ["rid", "question"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    vectors = labelled_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    shifted = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(shifted, F.col("vec_id") % 100 == 0)


ORACLE = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS anchor_id, q.label = c.label AS same, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
