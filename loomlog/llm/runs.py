"""Periodic runs in the words of texts, found by suffix automata.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) that holds its period `repeats`
times or more and can't be extended. Each state of a text's suffix automaton stands for strings that end at the same places.
From the longest states on, a state's ordered end positions are merged into its link's, the smaller set into the larger; two
positions that become neighbours there, d apart, have exactly that state's length of words before them in common. With d at
most (length / (repeats - 1)) they seed a repetition of period d that begins where those words do; the furthest seed of each
beginning is extended to the right, and of equal stretches the smallest period stays.

A word that stands fewer than `repeats` times in a stretch, or a pair of neighbours fewer than `repeats` - 1 times, lies in no
run: stretches are cut at these, over all texts of a step at once, until they hold no more of them. Automata are built for what
is left, so plain prose costs next to nothing. No shuffle; a text is a row of its own.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WORD, owners, picked, steps, words_of

REPEATS, LEAST = 4, 6
#: Positions of a block of an ordered set.
BLOCK = 2048
#: Rounds of cutting before automata are built; more would only save time.
ROUNDS = 8


class _Ends:
    """An ordered set of positions as blocks, so that adding costs little at any size."""

    __slots__ = ("blocks", "heads", "size")

    def __init__(self, at: int):
        self.blocks, self.heads, self.size = [[at]], [at], 1

    def add(self, x: int) -> tuple[int, int]:
        """Adds x and returns its neighbours, or -1."""
        b = max(0, bisect_left(self.heads, x) - 1)
        block = self.blocks[b]
        i = bisect_left(block, x)
        before = block[i - 1] if i else -1
        after = block[i] if i < len(block) else self.heads[b + 1] if b + 1 < len(self.heads) else -1
        block.insert(i, x)
        self.size += 1
        if not i:
            self.heads[b] = x
        if len(block) > 2 * BLOCK:
            self.blocks[b : b + 1] = block[:BLOCK], block[BLOCK:]
            insort(self.heads, block[BLOCK])
        return before, after

    def __iter__(self):
        for block in self.blocks:
            yield from block


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(length, link, end) of each state of the words' suffix automaton; end is -1 for clones and the root."""
    length, link, end, edges, last = [0], [-1], [-1], [{}], 0
    for at, w in enumerate(words):
        new = len(length)
        length.append(at + 1)
        link.append(0)
        end.append(at)
        edges.append({})
        p = last
        while p >= 0 and w not in edges[p]:
            edges[p][w] = new
            p = link[p]
        if p >= 0:
            q = edges[p][w]
            if length[q] != length[p] + 1:
                clone = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                end.append(-1)
                edges.append(dict(edges[q]))
                link[q] = clone
                while p >= 0 and edges[p].get(w) == q:
                    edges[p][w] = clone
                    p = link[p]
                q = clone
            link[new] = q
        last = new
    return length, link, end


def _seeds(words: list[int], repeats: int, floor: int) -> dict[tuple[int, int], int]:
    """(period, start) of repetitions, and how far each is known to reach. Words at distance d that have l words in common up to
    them and l >= (repeats - 1) d, l >= floor."""
    length, link, end = automaton(words)
    found: dict[tuple[int, int], int] = {}
    ends = [_Ends(e) if e >= 0 else None for e in end]
    for v in np.argsort(-np.array(length), kind="stable").tolist():
        p = link[v]
        mine, ends[v] = ends[v], None
        if p < 0 or length[p] < floor:
            continue  # what is shorter than the floor seeds nothing, nor do its links
        theirs = ends[p]
        if theirs is None:
            ends[p] = mine
            continue
        if mine.size > theirs.size:
            mine, theirs = theirs, mine
        common = length[p]
        furthest, last = common // (repeats - 1), -1
        for x in mine:
            before, after = theirs.add(x)
            if before > last and x - before <= furthest:  # (last and x were neighbours already)
                key = (x - before, before - common + 1)
                found[key] = max(found.get(key, 0), x + 1)
            if after >= 0 and after - x <= furthest:
                key = (after - x, x - common + 1)
                found[key] = max(found.get(key, 0), after + 1)
            last = x
        ends[p] = theirs
    return found


def _reach(words: np.ndarray, period: int, end: int) -> int:
    """How far words from end on continue the period."""
    step = 64
    while end < len(words):
        part = words[end : end + step]
        off = np.flatnonzero(part != words[end - period : end - period + len(part)])
        if len(off):
            return end + int(off[0])
        end, step = end + len(part), step * 2
    return end


def runs_of(words: np.ndarray, repeats: int = REPEATS, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of `repeats` periods and `least` words or more, by start, then period."""
    if len(words) < max(least, repeats):
        return []
    floor = min(max(least - q, (repeats - 1) * q) for q in range(1, max(2, least)))
    stretches: dict[tuple[int, int], int] = {}
    for (period, start), end in _seeds(words.tolist(), repeats, floor).items():
        key = (start, _reach(words, period, end))
        stretches[key] = min(period, stretches.get(key, period))
    return sorted((s, e - s, q) for (s, e), q in stretches.items() if e - s >= max(least, repeats * q))


def stretches(codes: np.ndarray, owner: np.ndarray, repeats: int = REPEATS, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Where stretches begin and end that may hold runs, in words of all texts laid end to end."""
    at, segment = np.arange(len(codes)), owner
    for _ in range(ROUNDS):
        before = len(at)
        if not before:
            break
        often = lambda keys, n: (lambda found: found[2][found[1]] >= n)(np.unique(keys, return_inverse=True, return_counts=True))
        width = int(codes.max()) + 1
        kept = often(segment * width + codes[at], repeats)
        at, segment = at[kept], segment[kept]
        segment = _numbered(at, segment)
        if len(at) > 1:
            pairs = np.unique(codes[at][:-1] * width + codes[at][1:], return_inverse=True)[1]
            joined = segment[1:] == segment[:-1]
            pairs = np.where(joined, segment[:-1] * (int(pairs.max()) + 1) + pairs, -1)
            cut = np.concatenate(([False], ~(often(pairs, repeats - 1) & joined)))
            segment = np.cumsum(cut)
        sizes = np.bincount(segment) if len(segment) else segment
        long = sizes[segment] >= least if len(segment) else np.zeros(0, dtype=bool)
        at, segment = at[long], segment[long]
        if len(at) == before:
            break
    segment = _numbered(at, segment)
    heads = np.flatnonzero(np.diff(segment, prepend=-1) != 0)
    tails = np.concatenate((heads[1:], [len(at)]))[: len(heads)] - 1
    return at[heads], at[tails] + 1


def _numbered(at: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Numbers of stretches: a new one at each gap and each change of segment."""
    return np.cumsum(np.concatenate(([0], (np.diff(at) != 1) | (np.diff(segment) != 0)))[: len(at)])


RUN = "struct<start:bigint,length:bigint,period:bigint>"
RESULT = f"doc_id long, n_words long, runs array<{RUN}>, collapsed string"


def _finder(repeats: int, least: int):
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            words, offsets = words_of(batch.column("text"))
            codes = words.dictionary_encode().indices.to_numpy().astype(np.int64) if len(words) else np.zeros(0, np.int64)
            owner, runs = owners(offsets), [[] for _ in range(len(batch))]
            gone = np.zeros(len(words) + 1, dtype=np.int64)
            for a, b in zip(*stretches(codes, owner, repeats, least), strict=True):
                text = int(owner[a])
                for start, length, period in runs_of(codes[a:b], repeats, least):
                    runs[text].append({"start": int(a - offsets[text]) + start, "length": length, "period": period})
                    gone[a + start + period] += 1
                    gone[a + start + length] -= 1
            kept = np.cumsum(gone)[:-1] == 0
            left = np.concatenate(([0], np.cumsum(kept)))[offsets]
            flat = words if kept.all() else words.filter(pa.array(kept))
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(left.astype(np.int32)), flat), " ")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(runs, kind), texts], ["doc_id", "n_words", "runs", "collapsed"])

    return found


def periodic_runs(docs: DataFrame, id: str = "doc_id", text: str = "text", repeats: int = REPEATS, least: int = LEAST) -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length, period in words from 0; by start, then period) and collapsed,
    the words joined by one space without those that any run holds after its first period.

    Null and empty texts have no words, no runs and an empty text. Documents with a null id and repeated rows have a row each; an
    empty table gives none. Of columns whose names differ in case only, the ones named exactly id and text count. A text is
    searched whole; the automaton of a stretch that may hold runs takes about half a kilobyte a word.
    """
    if repeats < 3:
        raise ValueError("runs of fewer than three periods aren't told by neighbours alone")
    return picked(docs, doc_id=id, text=text).mapInArrow(_finder(repeats, least), RESULT)


def _let(value: Column, body) -> Column:
    """body of the value, which is computed once."""
    return F.transform(F.array(value), body)[0]


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with long repetitions in about a tenth of the documents, a function of the id and the text alone."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def repeated(x: Column) -> Column:
        ws, n = x["ws"], F.size(x["ws"])
        a = F.pmod(g, n).cast("int")
        bound = F.struct(ws.alias("ws"), a.alias("a"), (1 + F.floor((n - a) / (3 + g % 8))).cast("int").alias("p"))
        return _let(bound, lambda y: F.array_join(F.transform(y["ws"], lambda w, i: F.when(i < y["a"], w).otherwise(F.get(y["ws"], y["a"] + (i - y["a"]) % y["p"]))), " "))

    words = F.struct(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("ws"))
    changed = _let(words, lambda x: F.when(F.size(x["ws"]) > 0, repeated(x)).otherwise(F.col("text")))
    return docs.select("doc_id", F.when(h % 10 == 0, changed).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    told = found.select("doc_id", "runs", "collapsed", best.alias("best"))
    length, period = F.col("best.length"), -F.col("best.period")
    return told.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


ORACLE = r"""
WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
    xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ord(c)::UBIGINT, 0, 0, 0, 0, 0, 0, 0]))),
        lambda c, b: xor(xor(c, b) >> 1, 3988292384::UBIGINT * (xor(c, b) & 1)))) AS h FROM documents),
p AS (SELECT *, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN ((h // 10) % len(ws)::UBIGINT)::BIGINT END AS a FROM t),
d AS (SELECT doc_id, CASE WHEN a IS NULL THEN ws ELSE list_transform(range(len(ws)), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (len(ws) - a) // (3 + ((h // 10) % 8)::BIGINT)) END]) END AS ws FROM p),
w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d),
g AS (SELECT doc_id, i, hash(w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) AS g, lead(i, 4) OVER o AS last FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
m AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM g x JOIN g y ON x.doc_id = y.doc_id AND x.g = y.g AND y.i > x.i WHERE x.last IS NOT NULL AND y.last IS NOT NULL),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + 4 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m) GROUP BY doc_id, q, island),
r AS (SELECT doc_id, start, length, min(q) AS q FROM s WHERE length >= greatest(6, 4 * q) GROUP BY ALL),
a AS (SELECT doc_id, count(*) AS n, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS t FROM r GROUP BY 1),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, q) = 1),
c AS (SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM r),
k AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS t FROM w ANTI JOIN c USING (doc_id, i) GROUP BY 1)
SELECT d.doc_id, coalesce(a.n, 0)::BIGINT AS n_runs, b.start::BIGINT AS start, b.length::BIGINT AS length, b.q::BIGINT AS period, (1000 * b.length // b.q)::BIGINT AS exponent_milli,
    sha256(coalesce(a.t, '')) AS runs_sha256, sha256(coalesce(k.t, '')) AS collapsed_sha256
FROM d LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id)
"""
