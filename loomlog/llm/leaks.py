"""Passages of test items in documents, found by an Aho-Corasick automaton over the items' normalised words.

A text's A-Z are lowered and its words are runs of ASCII letters, digits and all characters beyond ASCII. A window is WINDOW
consecutive words of an item (all of them, if it has fewer). The automaton holds the distinct windows as strings of words with
one space around each, so that it finds whole words only; documents are normalised the same way, a step of a task at a time,
and scanned once. What is found is told by words and, as normalisation keeps every byte in its place, by characters of the
original text.

Windows go to as many automata as their measured size asks for (PATTERN_BYTES each, one broadcast at a time a pass). With more
than one, the documents are written once with row numbers, scanned once for each, and only what was found is joined.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import numbered, picked, place_of, steps, written

WINDOW = 10
#: Bytes of distinct windows that one automaton holds; a byte is at most a node.
PATTERN_BYTES = 3 << 20

SPACE, BREAK = 32, 0
#: Normalisation byte by byte: A-Z are lowered, digits, a-z and all bytes of characters beyond ASCII stay, others are spaces.
_TABLE = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else SPACE for b in range(256)], dtype=np.uint8)


class Folded:
    """The normalised words of a column of texts: where each starts and ends, in bytes of all texts laid end to end."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts, "")
        width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        ends = np.frombuffer(texts.buffers()[1], dtype=width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        given = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
        self.offsets, self.bytes, self.letters = ends - ends[0], given, _TABLE[given]
        full = self.letters != SPACE
        edge = np.zeros(len(full) + 1, dtype=bool)  # where a text begins or all end
        edge[self.offsets] = True
        self.starts = np.flatnonzero(full & (edge[:-1] | ~np.concatenate(([False], full[:-1]))))
        self.ends = np.flatnonzero(full & (edge[1:] | ~np.concatenate((full[1:], [False])))) + 1
        self.owner = np.searchsorted(self.offsets, self.starts, side="right") - 1
        self.counts = np.bincount(self.owner, minlength=len(texts))
        self.first = np.concatenate(([0], np.cumsum(self.counts)))  # each text's first word
        self.full = full

    def line(self) -> tuple[np.ndarray, np.ndarray]:
        """All words with a space around each and a break between texts, and where each word starts in it."""
        sizes = self.ends - self.starts
        breaks = np.cumsum(np.diff(self.owner, prepend=-1) != 0)
        place = np.cumsum(sizes + 1) - (sizes + 1) + 2 * breaks
        out = np.full(int(place[-1] + sizes[-1] + 1) if len(sizes) else 0, SPACE, dtype=np.uint8)
        out[place[np.diff(self.owner, prepend=-1) != 0] - 2] = BREAK
        out[np.repeat(place - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))] = self.letters[self.full]
        return out, place

    def characters(self, text: int, at: np.ndarray) -> np.ndarray:
        """Places in bytes, of that text, as places in its characters."""
        begin, end = self.offsets[text : text + 2]
        heads = np.concatenate(([0], np.cumsum((self.bytes[begin:end] & 0xC0) != 0x80)))
        return heads[at - begin]


def _windows(window: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(pattern, words, item): the windows of every item."""
        for batch in steps(batches):
            folded, rows = Folded(batch.column("text")), []
            for i, item in enumerate(batch.column("item").to_pylist()):
                words = [folded.letters[a:b].tobytes() for a, b in zip(folded.starts[folded.first[i] : folded.first[i + 1]], folded.ends[folded.first[i] : folded.first[i + 1]], strict=True)]
                k = min(window, len(words))
                rows += [(b" " + b" ".join(words[at : at + k]) + b" ", k, item) for at in range(len(words) - k + 1 if k else 0)]
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int32(), pa.string()), strict=True)], ["pattern", "words", "item"])

    return cut


NAMES = ("begin", "end", "start", "stop")
SPAN = "struct<begin:bigint,end:bigint,start:bigint,stop:bigint>"
FOUND = f"n_words long, items array<string>, spans array<{SPAN}>"


class _Scan:
    """Streams texts through the automaton of the broadcast patterns, which each worker builds once."""

    def __init__(self, patterns, key: str):
        self.patterns, self.key, self.automaton = patterns, key, None

    def _built(self) -> ahocorasick.Automaton:
        automaton = ahocorasick.Automaton()
        for n, (pattern, words, _) in enumerate(self.patterns.value):
            automaton.add_word(pattern.decode("latin-1"), (n, words))
        automaton.make_automaton()
        return automaton

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, items_of = self._built() if self.patterns.value else None, [i for _, _, i in self.patterns.value]
        for batch in steps(batches):
            folded = Folded(batch.column("text"))
            items, spans = [[] for _ in range(len(batch))], [[] for _ in range(len(batch))]
            line, place = folded.line()
            if automaton is not None and len(line):
                hits = np.array([(end, *found) for end, found in automaton.iter(line.tobytes().decode("latin-1"))], dtype=np.int64).reshape(-1, 3)
                last = np.searchsorted(place, hits[:, 0], side="right") - 1
                for text, numbers in _groups(folded.owner[last], hits[:, 1]):
                    items[text] = sorted({i for n in np.unique(numbers).tolist() for i in items_of[n]})
                covered = np.zeros(len(place) + 1, dtype=np.int64)
                np.add.at(covered, last - hits[:, 2] + 1, 1)
                np.add.at(covered, last + 1, -1)
                hit = np.flatnonzero(np.cumsum(covered)[:-1] > 0)
                new = np.diff(hit, prepend=-2) > 1
                new |= np.diff(folded.owner[hit], prepend=-1) != 0
                begins = hit[new]
                ends = np.concatenate((hit[np.flatnonzero(new)[1:] - 1], hit[-1:])) + 1
                for text, pairs in _groups(folded.owner[begins], np.column_stack((begins, ends))):
                    edges = np.column_stack((folded.characters(text, folded.starts[pairs[:, 0]]), folded.characters(text, folded.ends[pairs[:, 1] - 1])))
                    spans[text] = [dict(zip(NAMES, row, strict=True)) for row in np.hstack((pairs - folded.first[text], edges)).tolist()]
            kind = pa.list_(pa.struct([(n, pa.int64()) for n in NAMES]))
            yield pa.RecordBatch.from_arrays([batch.column(self.key), pa.array(folded.counts), pa.array(items, pa.list_(pa.string())), pa.array(spans, kind)], [self.key, "n_words", "items", "spans"])


def _groups(owner: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(owner, its values), in order."""
    order = np.argsort(owner, kind="stable")
    owner, values = owner[order], values[order]
    heads = np.flatnonzero(np.diff(owner, prepend=-1) != 0)
    for a, b in zip(heads, np.append(heads[1:], len(owner))[: len(heads)], strict=True):
        yield int(owner[a]), values[a:b]


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of several scans of a text: those that overlap or touch made one."""
    for batch in batches:
        column = batch.column("spans")
        sizes, flat = pc.list_value_length(column).to_numpy(), column.flatten()
        of = np.repeat(np.arange(len(batch)), sizes)
        begin, end, start, stop = (flat.field(n).to_numpy() for n in NAMES)
        order = np.lexsort((begin, of))
        of, begin, end, start, stop = of[order], begin[order], end[order], start[order], stop[order]
        # ends of one text lie before those of the next once its number is added
        far = int(end.max()) + 2 if len(end) else 0
        reached = np.maximum.accumulate(end + of * far)
        head = np.concatenate(([True], begin[1:] + of[1:] * far > reached[:-1]))[: len(of)]
        heads = np.flatnonzero(head)
        tops = [np.maximum.reduceat(x, heads) if len(heads) else x for x in (end, stop)]
        merged = pa.StructArray.from_arrays([pa.array(x) for x in (begin[heads], tops[0], start[heads], tops[1])], list(NAMES))
        offsets = np.concatenate(([0], np.cumsum(np.bincount(of[heads], minlength=len(batch))))).astype(np.int32)
        spans = pa.ListArray.from_arrays(pa.array(offsets), merged)
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("doc_id", "n_words", "items")), spans], ["doc_id", "n_words", "items", "spans"])


def item_windows(items: DataFrame, id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(pattern, words, items): the distinct windows of all items, each with the ids, as strings, of those that hold it."""
    own = numbered(items).select(F.col(place_of(items, id)).cast("string").alias("item"), F.col(place_of(items, text)).alias("text"))
    return own.mapInArrow(_windows(window), "pattern binary, words int, item string").groupBy("pattern", "words").agg(F.array_sort(F.collect_set("item")).alias("items"))


def passages(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, pattern_bytes: int = PATTERN_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, items (ids of items with a window in it, as sorted strings) and spans, the runs of
    words that lie in windows: words [begin, end), characters [start, stop) of the original text.

    Null and empty texts have no words, on both sides; an item without words has no window. An item of a null id still hits
    words, but isn't among items; items of one id are one. Repeated documents have a row each, also with a null id. An empty
    table of items hits nothing; without documents there are no rows. Of columns whose names differ in case only, the ones
    named exactly count. A text of any length is scanned whole.
    """
    slim = picked(docs, doc_id=id, text=text)
    windows = written(item_windows(items, item_id, item_text, window), "windows")
    size = F.octet_length("pattern") + F.aggregate("items", F.lit(0), lambda n, i: n + F.octet_length(i))
    parts = max(1, math.ceil((windows.agg(F.sum(size)).first()[0] or 0) / pattern_bytes))
    context = docs.sparkSession.sparkContext

    def scan(rows: DataFrame, part: int, key: str) -> DataFrame:
        own = windows.filter(F.pmod(F.xxhash64("pattern"), F.lit(parts)) == part) if parts > 1 else windows
        patterns = context.broadcast([(bytes(r["pattern"]), r["words"], r["items"]) for r in own.collect()])  # bounded: about pattern_bytes
        return rows.mapInArrow(_Scan(patterns, key), f"{key} long, {FOUND}")

    if parts == 1:
        return scan(slim, 0, "doc_id")
    rows = written(slim.withColumn("rid", F.monotonically_increasing_id()), "rows")
    found = [scan(rows.select("rid", "text"), part, "rid") for part in range(parts)]
    sparse = [f if n == 0 else f.filter(F.size("spans") > 0) for n, f in enumerate(found)]  # the first tells every row's words
    every = sparse[0]
    for other in sparse[1:]:
        every = every.unionByName(other)
    told = every.groupBy("rid").agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))
    return rows.select("rid", "doc_id").join(told, "rid").select("doc_id", "n_words", "items", "spans").mapInArrow(_united, f"doc_id long, {FOUND}")


def op11_leaks(spark, sf_dir: str) -> DataFrame:
    found = passages(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM benchmark),
s AS (SELECT item_id, ws, least(10, len(ws)) AS k FROM b WHERE len(ws) > 0),
w AS (SELECT DISTINCT item_id, k, array_to_string(ws[i:i+k-1], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - k + 2)) AS i FROM s)),
x AS (SELECT doc_id, i, k, array_to_string(ws[i:i+k-1], ' ') AS g FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT k FROM w) WHERE len(ws) >= k)),
m AS (SELECT doc_id, i, k, item_id FROM x JOIN w USING (k, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n, string_agg(v, ',' ORDER BY v) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS v FROM m) GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
