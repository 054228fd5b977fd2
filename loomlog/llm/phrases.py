"""Removal of passages that recur across documents, by repeated-phrase automata.

A window is WINDOW consecutive words. A window of a document goes if the same words are also a window of a document with a
smaller id; its words are removed.

1. Anchors. Of the GRAM-word grams in a window the one with the smallest hash is its anchor, a function of the window's words
   alone: equal windows have equal anchors, and a fifth of a text's grams are anchors. Anchors are counted over all documents
   (partially aggregated); those of a single document are of no further interest.
2. Runs. Of each distinct text (exact copies need no search: a copy's windows all occur in the first of its kind) the runs
   of windows with a recurring anchor are cut out and dealt to shards by anchor. Those of a frequent anchor are dealt window
   by window, by the window's hash, so that its shards share no window.
3. Automata. A shard confirms which whole windows recur and where first, and compiles them, a bounded number at a time, to
   Aho-Corasick automata over overlapping ten-word letters, through which all its runs are streamed to locate every occurrence.
   Windows of a frequent anchor are confirmed by an aggregation first. Where one of its shards is large because a window stands
   in very many documents, it is split by document and each part gets the shard's confirmed windows: no more than a shard's
   rows, so all parts together get no more windows than there are rows.
4. The located windows return to the documents as ranges of words, by one join on the document.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import gram_hashes, longs, mixed, owners, picked, signed, steps, word_hashes, words_of, written

WINDOW, GRAM = 13, 5
#: Runs of one anchor that a shard takes, and words of whole shards that go to one automaton.
SHARD_SEGMENTS, AUTOMATON_WORDS = 4096, 400_000
#: Bytes of hash by which the automata tell a word, and entries of an anchor bucket.
WIDTH, BUCKET_ENTRIES = 6, 500_000
#: Recurring anchors that a task remembers to have told.
REMEMBERED = 1_000_000
#: Words of a letter of the automata: a window of 13 words is four overlapping letters of 10.
LETTER = 10
#: A letter's number is written in digits of this base.
DIGITS = 64


def anchors(hashes: np.ndarray, offsets: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of each text: where it starts, its anchor's hash, and its text's index."""
    starts = np.arange(max(0, len(hashes) - window + 1))
    if not len(starts):
        return starts, np.zeros(0, np.uint64), starts
    owner = owners(offsets)
    inside = owner[: len(starts)] == owner[window - 1 :]
    least = np.lib.stride_tricks.sliding_window_view(gram_hashes(hashes, gram), window - gram + 1).min(axis=1)
    starts = starts[inside]
    return starts, least[inside], owner[starts]


def _text_key(words: np.ndarray) -> tuple[int, int]:
    digest = xxhash.xxh3_128_intdigest(words.tobytes())
    return (digest & (2**64 - 1)) - 2**63, (digest >> 64) - 2**63


KEYS = "doc_id long, n_words long, k1 long, k2 long"


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A document's number of words and 128 bits of its word sequence."""
    for batch in steps(batches):
        words, offsets = words_of(batch.column("text"))
        hashes = word_hashes(words)
        keys = [_text_key(hashes[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64())], ["doc_id", "n_words", "k1", "k2"])


#: Anchors of a bucket, with a document each and whether they are known to recur, as packed arrays.
PACKED = "bucket long, anchors binary, docs binary, known binary"


def _bucketed(window: int, gram: int, buckets: int):
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Anchors by bucket. An anchor of several documents of a step recurs: its documents are told at once, in buckets from
        `buckets` on that only pass them on, and one of them alone goes to the anchor's bucket. The task remembers such anchors,
        so that a frequent one sends a single entry for all the steps of a task (as long as there are not too many of them)."""
        sent = np.zeros(0, dtype=np.uint64)
        for batch in steps(batches):
            words, offsets = words_of(batch.column("text"))
            _, anchor, owner = anchors(word_hashes(words), offsets, window, gram)
            if not len(anchor):
                continue
            docs = longs(batch.column("doc_id"))[owner]
            order = np.lexsort((docs, anchor))
            anchor, docs = anchor[order], docs[order]
            new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (docs[1:] != docs[:-1])))
            anchor, docs = anchor[new], docs[new]
            head = np.concatenate(([True], anchor[1:] != anchor[:-1]))
            size = np.diff(np.concatenate((np.flatnonzero(head), [len(anchor)])))
            firsts = anchor[head]
            told = sent[np.minimum(np.searchsorted(sent, firsts), len(sent) - 1)] == firsts if len(sent) else np.zeros(len(firsts), dtype=bool)
            several = np.repeat((size > 1) | told, size)
            if len(sent) < REMEMBERED:
                sent = np.union1d(sent, firsts[size > 1])
            head[head] = ~told
            bucket = (anchor % np.uint64(buckets)).astype(np.int64)
            passed = buckets + int(docs[0]) % buckets
            anchor, docs, known = np.concatenate((anchor[head], anchor[several])), np.concatenate((docs[head], docs[several])), np.concatenate((several[head], np.ones(int(several.sum()), bool)))
            bucket = np.concatenate((bucket[head], np.full(int(several.sum()), passed)))
            order = np.argsort(bucket, kind="stable")
            bucket, anchor, docs, known = bucket[order], anchor[order], docs[order], known[order]
            begins = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))[: len(bucket)]
            ends = np.concatenate((begins[1:], [len(bucket)]))[: len(begins)]
            cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(begins, ends, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(bucket[begins]), cut(anchor), cut(docs), cut(known)], ["bucket", "anchors", "docs", "known"])

    return packed


HITS = "anchor long, doc_id long"


def _recurring_anchors(buckets: int):
    def hits(table: pa.Table) -> pa.Table:
        """(anchor, doc_id) of the anchors that several documents hold."""
        bucket = table.column("bucket")[0].as_py()
        anchor, docs, known = (np.frombuffer(b"".join(table.column(c).to_pylist()), dtype=t) for c, t in (("anchors", np.uint64), ("docs", np.int64), ("known", bool)))
        if bucket < buckets:
            order = np.lexsort((docs, anchor))
            anchor, docs, known = anchor[order], docs[order], known[order]
            begins = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
            size = np.diff(np.concatenate((begins, [len(anchor)])))
            recurs = (np.minimum.reduceat(docs, begins) != np.maximum.reduceat(docs, begins)) | np.logical_or.reduceat(known, begins)
            keep = np.repeat(recurs, size) & ~known
            anchor, docs = anchor[keep], docs[keep]
        return pa.table({"anchor": pa.array(signed(np.ascontiguousarray(anchor))), "doc_id": pa.array(docs)})

    return hits


#: words: WIDTH bytes of hash for each of a run's words. A window is told by 13 of them. part is 0 where the anchor has one shard.
#: own: of an id that several texts share, half the key of the run's text; else 0.
SEGMENT = "anchor long, shards long, part long, doc_id long, own long, start long, words binary"


def _binary(values: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """For each (begin, size) WIDTH bytes of each value of that slice of the 64-bit values."""
    ends = np.cumsum(sizes)
    flat = values[np.repeat(begins - (ends - sizes), sizes) + np.arange(int(sizes.sum()))]
    flat = np.ascontiguousarray(flat.view(np.uint8).reshape(-1, 8)[:, :WIDTH])
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.concatenate(([0], ends * WIDTH)).astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])


def _segments(window: int, gram: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The runs of windows whose anchor recurs, single windows where it has several shards; recurring holds the document's
        anchors with their numbers of shards."""
        for batch in steps(batches):
            words, offsets = words_of(batch.column("text"))
            hashes = word_hashes(words)
            starts, anchor, owner = anchors(hashes, offsets, window, gram)
            if not len(starts):
                continue
            first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]))))
            last = np.concatenate((first[1:], [len(anchor)])) - 1
            lists = batch.column("recurring")
            of = np.repeat(np.arange(len(batch)), pc.list_value_length(lists).to_numpy())
            given = lists.flatten()
            salted = lambda a, d: mixed(a ^ (d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            known = salted(given.field("anchor").to_numpy().view(np.uint64), of)
            order = np.argsort(known)
            known, shards = known[order], given.field("shards").to_numpy()[order]
            mine = salted(anchor[first], owner[first])
            at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
            hit = known[at] == mine
            first, last, shards = first[hit], last[hit], shards[at[hit]]
            sizes = np.where(shards > 1, last - first + 1, 1)  # a frequent anchor's windows go one by one
            alone = np.repeat(shards > 1, sizes)
            first = np.repeat(first, sizes) + np.where(alone, np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes), 0)
            last, shards = np.where(alone, first, np.repeat(last, sizes)), np.repeat(shards, sizes)
            begin = starts[first]
            part = np.where(alone, (gram_hashes(hashes, window)[begin] % shards.astype(np.uint64)).astype(np.int64), 0)
            own = np.zeros(len(batch), dtype=np.int64)
            for i in np.flatnonzero(batch.column("shared").to_numpy(zero_copy_only=False)).tolist():
                own[i] = _text_key(hashes[offsets[i] : offsets[i + 1]])[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(anchor[first])), pa.array(shards), pa.array(part), batch.column("doc_id").take(pa.array(owner[first])), pa.array(own[owner[first]]), pa.array(begin - offsets[owner[first]]), _binary(hashes, begin, starts[last] - begin + window)],
                ["anchor", "shards", "part", "doc_id", "own", "start", "words"],
            )

    return cut


class _Rows:
    """The word hashes of a column of runs, laid end to end, and all their windows."""

    def __init__(self, column: pa.Array, window: int):
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        given = np.frombuffer(column.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]].reshape(-1, WIDTH)
        self.flat = np.zeros(len(given), dtype=np.uint64)
        self.flat.view(np.uint8).reshape(-1, 8)[:, :WIDTH] = given
        self.offsets = (ends - ends[0]) // WIDTH
        row = owners(self.offsets)
        places = np.arange(max(0, len(self.flat) - window + 1))
        inside = row[: len(places)] == row[window - 1 :]
        self.places, self.row = places[inside], row[: len(places)][inside]
        self.hashes = gram_hashes(self.flat, window)[inside]


def _recurring(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each window: where it first stands, its first and its last document, and how often it occurs."""
    order = np.lexsort((docs, hashes))
    heads = np.flatnonzero(np.concatenate(([True], hashes[order][1:] != hashes[order][:-1]))) if len(order) else order
    tails = np.concatenate((heads[1:], [len(order)]))[: len(heads)] - 1
    return order[heads], docs[order[heads]], docs[order[tails]], tails - heads + 1


def _first_windows(window: int):
    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(anchor, part, window, first and last document, occurrences), a window once for each batch."""
        for batch in batches:
            if batch.num_rows:
                rows = _Rows(batch.column("words"), window)  # one window each
                at, first, last, n = _recurring(rows.hashes, longs(batch.column("doc_id"))[rows.row])
                own = pa.array(rows.row[at])
                yield pa.RecordBatch.from_arrays([batch.column("anchor").take(own), batch.column("part").take(own), batch.column("words").take(own), pa.array(first), pa.array(last), pa.array(n)], ["anchor", "part", "words", "first", "last", "n"])

    return firsts


RANGES = "doc_id long, own long, begin long, end long"


def _signs(letters: np.ndarray, most: int) -> tuple[np.ndarray, int]:
    """Each letter (1 to most; 0: a gap) as k digits, told apart by their place; a node of the automaton looks through its
    children one by one, so it must not have thousands."""
    k = 1
    while DIGITS**k <= most:
        k += 1
    places = np.arange(k)
    digits = letters[:, None] // DIGITS**places % DIGITS + 1 + places * DIGITS
    return np.where(letters[:, None] > 0, digits, 0).ravel(), k


def _locate(table: pa.Table, window: int) -> pa.RecordBatch:
    """Compiles the recurring windows of whole shards to an automaton and streams the shards' runs through it."""
    rows = _Rows(table.column("words"), window)
    docs, own, start, shards = (longs(table.column(c)) for c in ("doc_id", "own", "start", "shards"))
    given = table.column("start").is_null().to_numpy()
    alone = ~given[rows.row] & (shards[rows.row] == 1)  # windows of shards that are confirmed here
    at, first, last, _ = _recurring(rows.hashes[alone], docs[rows.row[alone]])
    places, payload = rows.places[alone][at][first != last], first[first != last]
    confirmed = np.flatnonzero(given)
    places, payload = np.concatenate((places, rows.offsets[confirmed])), np.concatenate((payload, docs[confirmed]))
    found = np.zeros((0, 2), dtype=np.int64)
    if len(places):
        # a letter is LETTER words in a row, at each place; a window is as many letters as it has places for them
        letters = min(LETTER, window)
        length, row = window - letters + 1, owners(rows.offsets)
        numbers = np.unique(gram_hashes(rows.flat, letters), return_inverse=True)[1] + 1
        signs, k = _signs(numbers, int(numbers.max()))
        trie = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        sign = signs.tolist()
        for place, doc in zip((places * k).tolist(), payload.tolist(), strict=True):
            trie.add_word(tuple(sign[place : place + length * k]), doc)
        trie.make_automaton()
        begins = np.flatnonzero((row[: len(numbers)] == row[letters - 1 :]) & ~given[row[: len(numbers)]])
        spaced = np.arange(len(begins)) + row[begins]  # at least one 0, which is no letter, parts the runs
        text = np.zeros(len(begins) + table.num_rows + 1, dtype=np.int64)
        text[spaced] = numbers[begins]
        found = np.array(list(trie.iter(tuple(_signs(text, int(numbers.max()))[0].tolist()))), dtype=np.int64).reshape(-1, 2)
        found[:, 0] //= k
        back = np.zeros(len(text), dtype=np.int64)
        back[spaced] = begins
    if len(found):
        head, seen = back[found[:, 0]] - length + 1, found[:, 1]
        where = row[head]
        gone = seen < docs[where]
        head, where = head[gone], where[gone]
        inside = head - rows.offsets[where]
        new = np.concatenate(([True], (where[1:] != where[:-1]) | (inside[1:] - inside[:-1] > window)))[: len(where)]
        begins = np.flatnonzero(new)
        ends = np.concatenate((begins[1:], [len(where)]))[: len(begins)] - 1
        base = start[where[begins]].astype(np.int64)
        columns = docs[where[begins]], own[where[begins]], base + inside[begins], base + inside[ends] + window
    else:
        columns = (np.zeros(0, np.int64),) * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "own", "begin", "end"])


def _located(window: int, bound: int):
    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ranges of words to remove. Rows come by shard (anchor, part, sub); whole shards are gathered until their words fill an automaton."""
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.column("words").nbytes // WIDTH
            if size >= bound:
                table = pa.Table.from_batches(held)
                shard = np.column_stack([longs(table.column(c)) for c in ("anchor", "part", "sub")])
                changes = np.flatnonzero((shard[1:] != shard[:-1]).any(axis=1)) + 1
                at = 0
                while len(changes) and at < changes[-1]:  # so many whole shards at a time, the last one stays
                    lengths = pc.binary_length(table.column("words")).to_numpy()
                    full = np.searchsorted(np.cumsum(lengths[at:]) // WIDTH, bound) + at
                    to = changes[min(np.searchsorted(changes, max(full, at + 1)), len(changes) - 1)]
                    yield _locate(table.slice(at, to - at), window)
                    at = to
                held = table.slice(at).combine_chunks().to_batches()
                size = sum(b.column("words").nbytes // WIDTH for b in held)
        if held:
            yield _locate(pa.Table.from_batches(held), window)

    return located


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _cut_out(window: int):
    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            words, offsets = words_of(batch.column("text"))
            n = np.diff(offsets)
            gone = np.zeros(len(words) + 1, dtype=np.int64)
            # what was found for an id and a text; the texts' own keys are needed only where an id has several
            lists = [batch.column(c) for c in ("copies", "ranges")]
            row_of = [np.repeat(np.arange(len(batch)), pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False)) for x in lists]
            copies, ranges = (x.flatten() for x in lists)
            told = [longs(copies), longs(ranges.field("own"))]
            own = np.zeros(len(batch), dtype=np.int64)
            for i in np.unique(np.concatenate([r[t != 0] for r, t in zip(row_of, told, strict=True)])).tolist():
                own[i] = _text_key(word_hashes(words.slice(offsets[i], n[i])))[0]
            mine = [(t == 0) | (t == own[r]) for r, t in zip(row_of, told, strict=True)]
            copy = np.unique(row_of[0][mine[0]])
            np.add.at(gone, offsets[:-1][copy], 1)
            np.add.at(gone, offsets[1:][copy], -1)
            of = offsets[:-1][row_of[1]][mine[1]]
            np.add.at(gone, of + longs(ranges.field("begin"))[mine[1]], 1)
            np.add.at(gone, of + longs(ranges.field("end"))[mine[1]], -1)
            kept = np.cumsum(gone)[:-1] == 0
            left = np.concatenate(([0], np.cumsum(kept)))[offsets]
            flat = words.filter(pa.array(kept)) if not kept.all() else words
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(left.astype(np.int32)), flat), " ")
            digests = [hashlib.sha256(t.as_buffer() or b"").hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(n - np.diff(left)), pa.array(digests)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return removed


def repeated_ranges(docs: DataFrame, keys: DataFrame, firsts: DataFrame, shared: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, own, begin, end): word ranges of the documents in firsts (doc_id; one per distinct text) to remove. shared: the ids
    (doc_id, shared) of several texts, whose ranges are told by the text too."""
    entries = (keys.agg(F.sum("n_words")).first()[0] or 0) * 2 / (window - gram + 2)  # a window of w grams has about 2 / (w + 1) anchors a word
    buckets = max(1, math.ceil(entries / BUCKET_ENTRIES))
    found = docs.mapInArrow(_bucketed(window, gram, buckets), PACKED).groupBy("bucket").applyInArrow(_recurring_anchors(buckets), HITS)
    found = written(found.join(firsts, "doc_id", "left_semi"), "anchors")
    counted = found.groupBy("anchor").agg(F.count("*").alias("n"), F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).filter("x <> y")
    hits = found.join(counted.select("anchor", F.ceil(F.col("n") / SHARD_SEGMENTS).alias("shards")), "anchor")
    wanted = hits.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "shards")).alias("recurring"))  # bounded by the document's length
    wanted = wanted.join(shared, "doc_id", "left").withColumn("shared", F.coalesce("shared", F.lit(False)))
    frequent_only = wanted.select("doc_id", "shared", F.filter("recurring", lambda x: x["shards"] > 1).alias("recurring")).filter(F.size("recurring") > 0)
    # one plan, in which the shuffled documents serve both joins here and the last one of without_repeats
    cut = lambda w: docs.join(w, "doc_id").select("doc_id", "text", "recurring", "shared").mapInArrow(_segments(window, gram), SEGMENT)
    frequent = cut(frequent_only).select("anchor", "part", "doc_id", "words").mapInArrow(_first_windows(window), "anchor long, part long, words binary, first long, last long, n long")
    confirmed = frequent.groupBy("anchor", "part", "words").agg(F.min("first").alias("doc_id"), F.max("last").alias("z"), F.sum("n").alias("n")).filter("doc_id <> z AND n > 1")
    # (both uses of it read all its columns, so that Spark computes it once)
    # a shard of more rows than two shards' has a window in very many documents; such shards are few
    crowded = confirmed.groupBy("anchor", "part").agg(F.ceil(F.sum("n") / SHARD_SEGMENTS).alias("subs")).filter("subs > 2")
    subs = F.coalesce(F.col("subs"), F.lit(1).cast("long"))
    dealt = cut(wanted).join(crowded, ["anchor", "part"], "left").withColumn("sub", F.pmod(F.xxhash64("doc_id", "own", "start"), subs))
    given = confirmed.join(crowded, ["anchor", "part"], "left").withColumn("sub", F.explode(F.sequence(F.lit(0).cast("long"), subs - 1)))
    shards = ["anchor", "part", "sub"]
    columns = [*shards, "shards", "doc_id", "own", "start", "words"]
    rows = dealt.select(*columns).unionByName(given.select(*shards, F.lit(2).cast("long").alias("shards"), "doc_id", F.lit(0).cast("long").alias("own"), F.lit(None).cast("long").alias("start"), "words"))
    return rows.repartition(*shards).sortWithinPartitions(*shards).mapInArrow(_located(window, AUTOMATON_WORDS), RANGES)


def without_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 of the kept words joined by one space.

    Null text has no words. Texts shorter than a window lose nothing. Rows that share an id are one document as to order:
    they never remove each other's words, and each loses only what its own text shares with smaller ids. Rows with a null id remove
    nothing and lose nothing. An empty table gives no rows; of columns of like names the ones named exactly id and text count.
    """
    slim = picked(docs, doc_id=id, text=text)
    known = slim.filter(F.col("doc_id").isNotNull())
    keys = written(known.mapInArrow(_keys, KEYS), "keys")
    classes = written(keys.filter(F.col("n_words") >= window).groupBy("n_words", "k1", "k2").agg(F.min("doc_id").alias("first")), "texts")
    firsts = classes.select(F.col("first").alias("doc_id")).distinct()
    text = F.struct("n_words", "k1", "k2")
    shared = written(keys.groupBy("doc_id").agg(F.min(text).alias("a"), F.max(text).alias("b")).filter("a <> b").select("doc_id", F.lit(True).alias("shared")), "shared")
    ranges = repeated_ranges(known, keys, firsts, shared, window).groupBy("doc_id").agg(F.collect_list(F.struct("own", "begin", "end")).alias("ranges"))
    copies = keys.join(classes, ["n_words", "k1", "k2"]).filter("doc_id <> first").join(shared, "doc_id", "left")
    copies = copies.groupBy("doc_id").agg(F.collect_set(F.when(F.col("shared"), F.col("k1")).otherwise(0)).alias("copies"))
    found = known.join(ranges.join(copies, "doc_id", "full"), "doc_id", "left")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    nameless = slim.filter(F.col("doc_id").isNull()).select("doc_id", "text", none("array<struct<own:bigint,begin:bigint,end:bigint>>", "ranges"), none("array<bigint>", "copies"))
    every = found.select("doc_id", "text", "ranges", "copies").union(nameless)
    return every.mapInArrow(_cut_out(window), RESULT)


def op1_repeated_phrases(spark, sf_dir: str) -> DataFrame:
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) >= 13)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS f FROM w) WHERE f < doc_id),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM r),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM d) ANTI JOIN c USING (doc_id, p) GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
