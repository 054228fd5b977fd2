"""Near-duplicate documents by SetSketch registers (Ertl, 2021), confirmed on whole shingle sets.

1. Every document becomes its set of word shingles; documents with equal sets are one class, and only the class goes on.
2. A class has M registers. Register i is 1 - log_B(x), rounded down and cut to 16 bits, with x the smallest of
   exponentially distributed hashes of the set: sketches merge by maxima, and registers agree about as often as sets do.
3. Bands of registers name buckets. In a bucket every member is paired with one hub, the member that shares most buckets
   with others, which in a family of copies is as a rule their source: pairs grow with the members, not with their square.
4. For each pair the likelihood of the three counts (registers of a below, equal to and above those of b), given the sets'
   sizes, is maximised over the Jaccard similarity. Only pairs far below the threshold go.
5. The others are confirmed on the whole texts, and confirmed links joined to components.
6. All members of the buckets of one hub are a family. If they are still of several components, links may be hidden that the
   hub doesn't have. There, each member outside the largest component is checked on whole sets against all the family, in
   blocks of bounded size: mostly its own shingles already show that it has no link (fewer than 80 % of them occur in the
   block); otherwise intersections are counted from the block's postings. A block returns at most one link for each component.
   Texts are read once for their sets; a family's sets go to as many blocks as its members outside the largest component fill.
   So no partner is left out for the size of a bucket, and no list of pairs is ever made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import gram_hashes, mixed, numbered, picked, place_of, signed, steps, word_hashes, words_of, written

#: Registers, their base, the exponential rate and the largest register value.
M, BASE, RATE, TOP = 112, 1.001, 20.0, 65_534
#: Registers of a band: 28 bands of 4 miss a pair of similarity 0.8 once in two million.
BAND = 4
#: Standard deviations of the estimate that a pair may lie below the threshold.
MARGIN = 5.5
#: Members of a confirmation group; members and shingles of a block of an open family.
CHUNK, BLOCK, BLOCK_SHINGLES = 64, 1024, 1_000_000
#: Members of open families (two numbers each) that are broadcast to the documents at most.
MOST_BROADCAST = 500_000

_MULTIPLIERS = np.random.default_rng(5).integers(0, 2**31, M, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' distinct shingle hashes (each set ascending) and the sets' offsets. A to Z are lower-cased.

    A shingle is k words; a text with fewer has its whole word sequence as the only one, without words it has none.
    """
    words, offsets = words_of(pc.ascii_lower(texts))
    hashes = word_hashes(words)
    grams, counts = gram_hashes(hashes, k), np.diff(offsets)
    sets = []
    for begin, n in zip(offsets[:-1].tolist(), counts.tolist(), strict=True):
        if n >= k:
            own = np.sort(grams[begin : begin + n - k + 1])
            sets.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        elif n:
            sets.append(gram_hashes(hashes[begin : begin + n], n))
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)


def registers(hashes: np.ndarray, offsets: np.ndarray, m: int = M) -> np.ndarray:
    """The m registers of each set (16 bits, one row per set; zeros for an empty set). Sets merge by their maxima."""
    full = np.diff(offsets) > 0
    out = np.zeros((len(full), m), dtype=np.uint16)
    if not full.any():
        return out
    starts, short = offsets[:-1][full], (hashes >> np.uint64(32)).astype(np.uint32)
    for i in range(m):
        least = np.minimum.reduceat(short * _MULTIPLIERS[i], starts)
        x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / RATE
        out[full, i] = np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP + 1)
    return out


def fingerprints(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, whatever its order."""
    out = []
    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(hashes ^ np.uint64(salt)))))
        out.append(mixed(sums[offsets[1:]] - sums[offsets[:-1]]))
    return out[0], out[1]


SKETCH = "doc_id long, text_hash long, n_shingles long, f1 long, f2 long, regs binary"


def _sketcher(k: int):
    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            hashes, offsets = shingle_sets(batch.column("text"), k)
            f1, f2 = fingerprints(hashes, offsets)
            regs = registers(hashes, offsets)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * M), len(regs), [None, pa.py_buffer(regs.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(np.diff(offsets)), pa.array(signed(f1)), pa.array(signed(f2)), packed], ["doc_id", "text_hash", "n_shingles", "f1", "f2", "regs"])

    return sketched


def joint_estimate(below: np.ndarray, equal: np.ndarray, above: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The similarity of greatest likelihood, from how many registers of a are below, equal to and above those of b."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    most = np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    lo, hi = np.zeros_like(most), most.copy()

    def likelihood(j):
        up, down = p(u - v * j), p(v - u * j)
        tiny = 1e-12
        return above * np.log(np.maximum(up, tiny)) + below * np.log(np.maximum(down, tiny)) + equal * np.log(np.maximum(1 - up - down, tiny))

    third = (np.sqrt(5) - 1) / 2
    for _ in range(22):  # golden section: the likelihood is concave in j
        a, b = hi - third * (hi - lo), lo + third * (hi - lo)
        left = likelihood(a) >= likelihood(b)
        hi, lo = np.where(left, b, hi), np.where(left, lo, a)
    return (lo + hi) / 2


def _passes(regs_a: np.ndarray, regs_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs (row by row) may have the similarity: by the sets' sizes exactly, then by the estimate with a margin."""
    sized = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    below, equal = (regs_a < regs_b).sum(axis=1), (regs_a == regs_b).sum(axis=1)
    estimate = joint_estimate(below, equal, M - below - equal, n_a.astype(float), n_b.astype(float))
    j = percent / 100
    return sized & (estimate >= j - MARGIN * np.sqrt(j * (1 - j) / M))


def _unpacked(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(len(column), M)


def _estimator(percent: int):
    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = _passes(_unpacked(batch.column("regs_a")), _unpacked(batch.column("regs_b")), batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy(), percent)
                yield batch.filter(pa.array(keep)).select(["a", "b"])

    return likely


def _confirmer(k: int, percent: int):
    def confirmed(table: pa.Table) -> pa.Table:
        """Links between the hub of the group (role 0) and its members (role 1), on whole sets."""
        table = table.combine_chunks()
        hub, found = None, []
        ids, roles = table.column("doc_id").to_numpy(), table.column("role").to_numpy()
        order = np.argsort(roles, kind="stable")
        for at in order.tolist():
            own, offsets = shingle_sets(table.column("text").slice(at, 1).combine_chunks(), k)
            f1, _ = fingerprints(own, offsets)
            if int(signed(f1)[0]) != table.column("f1")[at].as_py():
                continue  # another text under the same id
            if roles[at] == 0:
                hub, hub_id = own, int(ids[at])
            elif hub is not None and int(ids[at]) != hub_id:
                both = len(np.intersect1d(hub, own, assume_unique=True))
                if 100 * both >= percent * (len(hub) + len(own) - both):
                    found.append((int(ids[at]), hub_id))
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    return confirmed


def confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b = hub) whose whole sets are similar enough, as a written table.

    The documents are shuffled once; only asked-for texts go on, a hub's once for each CHUNK of its members.
    """
    sizes = pairs.groupBy("b").agg(F.count("*").alias("n")).select(F.col("b").alias("hub"), F.ceil(F.col("n") / CHUNK).alias("chunks"))
    grouped = pairs.join(sizes, F.col("b") == F.col("hub")).select("a", "b", F.pmod(F.xxhash64("a"), F.col("chunks")).alias("part"))
    members = grouped.select(F.col("a").alias("rep"), F.col("b").alias("hub"), "part", F.lit(1).alias("role"))
    hubs = grouped.select(F.col("b").alias("rep"), F.col("b").alias("hub"), "part", F.lit(0).alias("role")).distinct()
    asked = members.union(hubs).join(classes.select("rep", "f1"), "rep")
    texts = docs.join(asked, docs["doc_id"] == asked["rep"]).select("hub", "part", "doc_id", "role", "f1", "text")
    return written(texts.groupBy("hub", "part").applyInArrow(_confirmer(k, percent), "a long, b long"), "links")


class _Postings:
    """The sets of a block by shingle."""

    def __init__(self, sets: list[np.ndarray]):
        every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        order = np.argsort(every, kind="stable")
        self.owner, self.n = owner[order], len(sets)
        self.shingles, self.begin = np.unique(every[order], return_index=True)
        self.count = np.diff(np.concatenate((self.begin, [len(every)])))

    def places(self, own: np.ndarray) -> np.ndarray:
        """Where the shingles of own that the block has are."""
        at = np.minimum(np.searchsorted(self.shingles, own), max(0, len(self.shingles) - 1))
        return at[self.shingles[at] == own] if len(self.shingles) else at[:0]

    def intersections(self, at: np.ndarray) -> np.ndarray:
        """How many of the shingles at those places each set of the block has."""
        n = self.count[at]
        flat = np.repeat(self.begin[at] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
        return np.bincount(self.owner[flat], minlength=self.n)


SETS = "rep long, shingles binary"


def _set_maker(k: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The whole shingle sets of the texts that have the asked fingerprint (others are another text under the same id)."""
        for batch in steps(batches):
            hashes, offsets = shingle_sets(batch.column("text"), k)
            right = signed(fingerprints(hashes, offsets)[0]) == batch.column("f1").to_numpy()
            packed = [hashes[a:b].tobytes() for a, b in zip(offsets[:-1][right], offsets[1:][right], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("rep").filter(pa.array(right)), pa.array(packed, pa.binary())], ["rep", "shingles"])

    return sets


def _block_pair(percent: int):
    def linked(table: pa.Table) -> pa.Table:
        """Links between members outside the main component (side 0) and members of the family (side 1), one for each two components."""
        sides = []
        for side in (0, 1):
            part = table.filter(pc.equal(table.column("side"), side))
            sets = [np.frombuffer(x, dtype=np.uint64) for x in part.column("shingles").to_pylist()]
            sides.append((sets, part.column("rep").to_pylist(), part.column("comp").to_pylist()))
        (left, left_reps, left_comps), (right, right_reps, right_comps) = sides
        postings, place = _Postings(right), {r: i for i, r in enumerate(right_reps)}
        sizes, comps = np.array([len(x) for x in right]), np.array(right_comps)
        joined: dict[int, int] = {}

        def root(c: int) -> int:
            while joined.get(c, c) != c:
                c = joined[c]
            return c

        found = []
        for own, rep, comp in zip(left, left_reps, left_comps, strict=True):
            at = postings.places(own)
            shared = int((postings.count[at] > (rep in place)).sum())  # shingles that a member other than rep has
            if 100 * shared < percent * len(own):
                continue
            both = postings.intersections(at)
            for i in np.flatnonzero((100 * both >= percent * (len(own) + sizes - both)) & (comps != comp)).tolist():
                a, b = root(comp), root(int(comps[i]))
                if a != b:
                    joined[max(a, b)] = min(a, b)
                    found.append((rep, right_reps[i]))
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    return linked


def hidden_links(pairs: DataFrame, comps: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) across components within the families of pairs (a, b = hub), as a written table."""
    members = pairs.select("b", F.col("a").alias("rep")).union(pairs.select("b", F.col("b").alias("rep")).distinct()).withColumnRenamed("b", "hub")
    sized = members.join(classes.select("rep", "n_shingles", "f1"), "rep").join(comps, F.col("rep") == F.col("node"), "left")
    labelled = written(sized.select("hub", "rep", "f1", "n_shingles", F.coalesce("component", "rep").alias("comp")), "families")
    shares = labelled.groupBy("hub", "comp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    families = shares.groupBy("hub").agg(F.max(F.struct("n", "comp", "s")).alias("top"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("c")).filter("c > 1")
    blocks = lambda n, s: F.greatest(F.ceil(n / BLOCK), F.ceil(s / BLOCK_SHINGLES)).cast("int")
    outside = blocks(F.col("n") - F.col("top.n"), F.col("s") - F.col("top.s"))
    families = families.select("hub", F.col("top.comp").alias("main"), outside.alias("lefts"), blocks(F.col("n"), F.col("s")).alias("rights"))
    open_rows = written(labelled.join(written(families, "open"), "hub"), "members")  # a written table, so that the join may split a large family
    asked = written(open_rows.select("rep", "f1").distinct(), "asked")
    asked = F.broadcast(asked) if asked.count() <= MOST_BROADCAST else asked  # else the documents are shuffled
    sets = written(docs.join(asked, docs["doc_id"] == asked["rep"]).select("rep", "f1", "text").mapInArrow(_set_maker(k), SETS).dropDuplicates(["rep"]), "sets")
    own = lambda blocks: F.pmod(F.xxhash64("rep"), F.col(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    left = open_rows.filter("comp <> main").select("hub", own("lefts").alias("i"), every("rights").alias("j"), F.lit(0).alias("side"), "rep", "comp")
    right = open_rows.select("hub", every("lefts").alias("i"), own("rights").alias("j"), F.lit(1).alias("side"), "rep", "comp")
    sides = left.unionByName(right).join(sets, "rep").select("hub", "i", "j", "side", "rep", "comp", "shingles")
    return written(sides.groupBy("hub", "i", "j").applyInArrow(_block_pair(percent), "a long, b long"), "hidden")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest id reachable by links), text_hash (xxhash64), kept.

    Two documents are linked if 100 |intersection| >= percent |union| of their sets of shingles. Null and empty texts, and
    texts without words, have an empty set and are linked with nothing. Rows with a null id are in no component (null) and
    are kept. Rows that share an id but not the text are judged each by its text. Other columns play no part.
    """
    slim = picked(docs, doc_id=id, text=text)
    sketches = written(slim.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_sketcher(shingle), SKETCH), "sketches")
    classes = written(sketches.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("regs").alias("regs")), "classes")

    bands = F.transform(F.sequence(F.lit(0), F.lit(M // BAND - 1)), lambda i: F.xxhash64(i, F.substring(F.col("regs"), i * (2 * BAND) + 1, F.lit(2 * BAND))))
    banded = classes.select("rep", F.explode(bands).alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    rows = written(banded.join(shared, "key"), "buckets")
    ranked = rows.join(rows.groupBy("rep").agg(F.sum("n").alias("weight")), "rep")
    hubs = ranked.groupBy("key").agg(F.max(F.struct("weight", (-F.col("rep")).alias("r"))).alias("top")).select("key", (-F.col("top.r")).alias("hub"))
    pairs = written(rows.join(hubs, "key").filter("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct(), "pairs")
    side = lambda s: classes.select(F.col("rep").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("regs").alias(f"regs_{s}"))
    likely = written(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_estimator(percent), "a long, b long"), "likely")
    links = confirm(likely, classes, slim, shingle, percent)
    comps = components(links)
    hidden = hidden_links(pairs, comps, classes, slim, shingle, percent)
    if not hidden.isEmpty():
        comps = components(links.union(hidden))
    found = classes.join(comps, F.col("rep") == F.col("node"), "left").select("n_shingles", "f1", "f2", F.coalesce("component", "rep").alias("component_id"))
    joined = sketches.select("doc_id", "text_hash", "n_shingles", "f1", "f2").join(found, ["n_shingles", "f1", "f2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), "text_hash").withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each component, the one of the smallest id; columns as they are.

    Documents without words, and those with a null id, all stay. Of repeated rows (same id and text) one stays.
    """
    found = written(near_duplicates(docs, shingle, percent, id, text), "components")
    kept = found.filter("kept").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"))
    own, body = place_of(docs, id), place_of(docs, text)
    given = numbered(docs).withColumn("_hash", F.xxhash64(body))
    left = given.join(kept, F.col(own).cast("long").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("text_hash")), "left_semi")
    if not kept.filter("n > 1 AND doc_id IS NOT NULL").isEmpty():
        left = left.filter(F.col(own).isNotNull()).dropDuplicates([own, "_hash"]).union(left.filter(F.col(own).isNull()))
    return left.drop("_hash").toDF(*docs.columns)


def op5_setsketch(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=4).select("doc_id", "n_shingles", "component_id", "kept")


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN len(ws)::VARCHAR || ' ' || array_to_string(ws, ' ') ELSE array_to_string(ws[i:i+3], ' ') END AS g
    FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY 1) m ON m.a = d.doc_id
"""
