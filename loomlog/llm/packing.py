"""Sum-of-squares packing of tokenized documents into sequences of at most a given length.

The rule (online bin packing by Csirik et al.): with N(g) open bins of residual gap g, put an item of size s where the sum
of N(g)^2 becomes smallest, i.e. where N(g) - N(g - s) is largest; a new bin, which adds one to N(length - s), is a candidate
like any other. Full bins count for nothing. As all pieces are known, they come largest first, and once as many bins are open
as the total length needs at least, another is opened only when no open bin has room: that ends within 0.05 % of the least
number on the test tables, the rule without it 0.5 % higher (largest first) or 2 % (in random order).

Documents are tokenized where they lie; only piece lengths are shuffled. Pieces are dealt by a hash to groups of about
GROUP_PIECES, and each group packs its own bins, largest pieces first, so the work is parallel and a lost executor costs
one group. A group leaves a few bins part full.

A table whose order is to last (the mix of sources) is packed by windows of it instead: contiguous ranges of WINDOW_PIECES
pieces in the order of the written rows, each packed by itself, with sequences numbered by their earliest piece. So the
sequences up to any window's end hold exactly the pieces up to it, in the sources' shares of the mix.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import picked, small_batches, steps, written

LENGTH = 1024
#: Token written after each document.
END = 2
GROUP_PIECES = 60_000
#: Pieces of a window of an ordered table, some hundred blocks of a mix.
WINDOW_PIECES = 2_048
#: Rows of a file whose pieces are counted together.
CHUNK_ROWS = 4_096

#: Characters that both tokenizer libraries are known (and tested) to split alike; other texts go to the slower one.
_COMMON = re.compile("[^\\x09-\\x0d\\x20-\\x7e\\u00a1-\\u024f\\u2010-\\u2027]")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def _encoders(path: str):
    """The tokenizer of the file, the same vocabulary in a library that is five times as fast on one core, and the special tokens."""
    import json

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    special = tuple(token.content for token in slow.get_added_tokens_decoder().values())
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    codes = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file
    letters = {chr(b): b for b in codes} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(codes))}
    ranks = {bytes(letters[c] for c in piece): i for piece, i in model["vocab"].items() if all(c in letters for c in piece)}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return slow, fast, special


def token_ids(text: str, path: str) -> np.ndarray:
    """Ids of the whole text, without the end token. A special token's string is that token, as the tokenizer file has it."""
    slow, fast, special = _encoders(path)
    if _COMMON.search(text) or any(s in text for s in special):
        return np.array(slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
    return np.array(fast.encode_ordinary(text), dtype=np.uint32)


def cut(total: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: only what is longer is cut, and only the first piece may be shorter."""
    first = total % length or length
    return [(0, min(first, total)), *((s, length) for s in range(first, total, length))] if total > length else [(0, total)]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Where a row lies in a written table: the file by its place among the writer's, and the row in it.
PLACE = ("_file", "_row")


class _Tokenize:
    def __init__(self, length: int, end: int, path: str):
        self.length, self.end, self.path = length, end, path

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = np.array([self.end], dtype=np.uint32)
        for batch in steps(batches):
            rows, places = [], [batch.column(n) for n in batch.schema.names if n in PLACE]
            owner = []
            for at, (doc, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True)):
                ids = np.concatenate((token_ids(text.as_py() or "", self.path), tail)).astype("<u4")
                rows += [(doc, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cut(len(ids), self.length))]
                owner += [at] * (len(rows) - len(owner))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            columns += [c.take(pa.array(owner)) for c in places]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", *PLACE[: len(places)]])


def place(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item (1 <= size <= length), taken largest first, and the number of bins. Ties go to an open bin
    before a new one, then to the smaller gap.

    When the least number of bins that the sizes need are open, a new one is opened only if no open bin has room.
    """
    order = np.argsort(-sizes, kind="stable")
    counts = np.zeros(length + 1, dtype=np.int64)  # open bins by gap; full ones (gap 0) are not open
    open_bins: list[list[int]] = [[] for _ in range(length + 1)]
    bins, offsets, used = np.empty(len(sizes), dtype=np.int64), np.empty(len(sizes), dtype=np.int64), 0
    least = -(-int(sizes.sum()) // length)
    for item in order.tolist():
        s = int(sizes[item])
        room = counts[s:] > 0
        # what the sum of squares falls by if gap g loses a bin and gap g - s wins one, which an exact fit doesn't
        fall = 2 * (counts[s:] - counts[: length + 1 - s]) - 2
        fall[0] = 2 * counts[s] - 1
        g = s + int(np.argmax(np.where(room, fall, np.iinfo(np.int64).min)))
        new = 0 if s == length else -2 * int(counts[length - s]) - 1
        if room.any() and (used >= least or fall[g - s] >= new):
            b = open_bins[g].pop()
            counts[g] -= 1
        else:
            g, b, used = length, used, used + 1
        bins[item], offsets[item] = b, length - g
        if g > s:
            open_bins[g - s].append(b)
            counts[g - s] += 1
    return bins, offsets, used


def _packer(length: int):
    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        sizes = table.column("length").to_numpy()
        bins, offsets = np.empty(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
        full = sizes >= length
        bins[~full], offsets[~full], used = place(sizes[~full], length)
        bins[full] = used + np.arange(int(full.sum()))
        base = table.column("pack_group")[0].as_py() << 36
        return table.drop_columns(["pack_group"]).append_column("sequence_id", pa.array(bins + base)).append_column("offset", pa.array(offsets))

    return packed


def _window_packer(length: int):
    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by("_rank")
        bins, offsets, used = place(sizes := table.column("length").to_numpy(), length)
        first = np.full(used, len(sizes), dtype=np.int64)
        np.minimum.at(first, bins, np.arange(len(sizes)))
        number = np.empty(used, dtype=np.int64)
        number[np.argsort(first)] = np.arange(used)
        base = table.column("_window")[0].as_py() << 36
        return table.drop_columns(["_window", "_rank"]).append_column("sequence_id", pa.array(number[bins] + base)).append_column("offset", pa.array(offsets))

    return packed


def pack_in_order(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, end: int = END, window_pieces: int = WINDOW_PIECES, path: str | None = None) -> DataFrame:
    """Rows as pack() makes them, of a Parquet table as read, packed by windows of its order; sequence_id ascends in that order.

    The order is that of the writer's files and of the rows in each, which is the order that was written. Null text is empty (one
    end token); a null id stays null. Repeated rows are packed each, in their places, so there are no ties. An empty table gives no
    rows, and a text of any length is tokenized whole and cut. Other columns play no part, also one named _metadata; a table as
    read holds no two names that differ in case only (written() tells such apart).
    """
    path = path or vocabulary_path()
    file = docs.metadataColumn("_metadata")
    name = file["file_name"]
    part = lambda of: F.coalesce(F.nullif(F.regexp_extract(name, of, 1), F.lit("")).cast("long"), F.lit(0).cast("long"))
    # part-00012-...-c003.snappy.parquet: the task, and its files one after the other
    named = docs.select(F.col(f"`{id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), (part(r"^part-(\d{1,12})") * (1 << 20) + part(r"-c(\d{1,6})\.")).alias("_file"), file["row_index"].alias("_row"))
    small_batches(docs.sparkSession)
    pieces = written(named.mapInArrow(_Tokenize(length, end, path), PIECES + ", _file long, _row long"), "pieces").withColumn("_chunk", F.floor(F.col("_row") / CHUNK_ROWS))
    counts = pieces.groupBy("_file", "_chunk").agg(F.count("*").alias("_n"))
    # the driver lists the table's files anyway
    files = sorted((r["_file"], r["n"]) for r in counts.groupBy("_file").agg(F.sum("_n").alias("n")).collect())
    starts, total = [], 0
    for file, n in files:
        starts.append((file, total))
        total += n
    earlier = docs.sparkSession.createDataFrame(starts, "_file long, _earlier long")
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_file").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chunks = counts.withColumn("_before", before).join(earlier, "_file").select("_file", "_chunk", (F.col("_earlier") + F.col("_before")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_file", "_chunk").orderBy("_row", "piece", "doc_id")) - 1
    ranked = pieces.withColumn("_inside", inside).join(chunks, ["_file", "_chunk"]).withColumn("_rank", F.col("_before") + F.col("_inside"))
    dealt = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "_rank", F.floor(F.col("_rank") / window_pieces).alias("_window"))
    return dealt.groupBy("_window").applyInArrow(_window_packer(length), PIECES + ", sequence_id long, offset long")


def pack(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, end: int = END, group_pieces: int = GROUP_PIECES, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text is empty (one end token). Repeated rows are packed each. An empty table gives none. A text of any length is
    tokenized whole and cut. Of columns whose names differ in case only, the ones named exactly id and text count.
    """
    path = path or vocabulary_path()
    pieces = written(picked(docs, doc_id=id, text=text).mapInArrow(_Tokenize(length, end, path), PIECES), "pieces")
    groups = max(1, math.ceil(pieces.count() / group_pieces))
    dealt = pieces.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int"))
    return dealt.groupBy("pack_group").applyInArrow(_packer(length), PIECES + ", sequence_id long, offset long")


def op4_sum_of_squares(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
