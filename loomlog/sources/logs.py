"""A Spark data source of append-only line logs: byte ranges of files in batch, committed offsets and a byte budget in streams.

    spark.dataSource.register(LogSource)
    spark.read.format("agentlogs").option("path", root).load()
    spark.readStream.format("agentlogs").option("path", root).option("trigger_bytes", 1 << 28).load()

A partition is a range of bytes of one file and yields the lines that begin in it, with their places, so no line is shuffled or
sorted to be placed and no task holds more than a chunk and a line. What has been read of a file is told by an offset that is
always the end of a line: a later read starts there, if the file's head and the bytes before the offset are as they were, else
from the beginning, its rows marked rewritten. A stream commits these offsets with its checkpoint; a trigger reads at most
trigger_bytes (a longer line whole), files that were served longest ago first. A file that can't be read gives one row with an
error and no line.
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bytes of a partition, and of a trigger of a stream.
SPLIT_BYTES, TRIGGER_BYTES = 64 << 20, 1 << 30
#: Bytes read at a time, and bytes of either end of what was read that a later read checks.
CHUNK, CHECKED = 1 << 20, 65_536
#: Lines of a batch of rows.
BATCH_LINES = 4_096

SCHEMA = "path string, byte_offset long, byte_length long, line_no long, raw string, rewritten boolean, error string"
_SCHEMA = pa.schema([("path", pa.string()), ("byte_offset", pa.int64()), ("byte_length", pa.int64()), ("line_no", pa.int64()), ("raw", pa.string()), ("rewritten", pa.bool_()), ("error", pa.string())])


@dataclass
class Piece(InputPartition):
    """Lines of a file that begin in [start, stop) and end by limit; first_line is the number of lines before, if known."""

    path: str
    start: int
    stop: int
    limit: int
    first_line: int | None
    rewritten: bool
    at_line: bool
    error: str | None = None
    gone_is_fatal: bool = False


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), os.path.abspath(path))


def _named(store: pafs.FileSystem, root: str, path: str) -> str:
    """The name that Spark's own readers give a file."""
    return f"file:{path}" if isinstance(store, pafs.LocalFileSystem) else root.split("://", 1)[0] + "://" + path


def listed(root: str, pattern: str = "*.jsonl", strict: bool = False) -> dict[str, tuple[int, int]]:
    """Size and time (microseconds) of each file below root whose name fits, in order of their names. Links and empty files are left
    out. A root that isn't there has no files, unless strict."""
    store, base = _store(root)
    found = store.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=not strict))
    local = isinstance(store, pafs.LocalFileSystem)
    files = [f for f in found if f.type == pafs.FileType.File and f.size and fnmatch.fnmatch(f.base_name, pattern) and not (local and os.path.islink(f.path))]
    return {_named(store, root, f.path): (f.size, (f.mtime_ns or 0) // 1000) for f in sorted(files, key=lambda f: f.path)}


def _opened(path: str) -> pa.NativeFile:
    store, inside = _store(path)
    return store.open_input_file(inside)


def _line_end(file: pa.NativeFile, start: int, limit: int, size: int) -> int:
    """The end of the last line that ends in (start, limit]; if none does, of the first one after; start, if there is none."""
    at = limit
    while at > start:
        low = max(start, at - CHECKED)
        file.seek(low)
        if (found := file.read(at - low).rfind(b"\n")) >= 0:
            return low + found + 1
        at = low
    at = limit
    while at < size:
        file.seek(at)
        content = file.read(min(CHUNK, size - at))
        if not content:
            break
        if (found := content.find(b"\n")) >= 0:
            return at + found + 1
        at += len(content)
    return start


def _ends(file: pa.NativeFile, offset: int) -> str:
    """A digest of the first and of the last CHECKED bytes before the offset."""
    file.seek(0)
    head = file.read(min(offset, CHECKED))
    file.seek(max(0, offset - CHECKED))
    return hashlib.sha256(head + b"|" + file.read(min(offset, CHECKED))).hexdigest()[:24]


def advanced(files: dict[str, tuple[int, int]], known: dict, budget: int | None = None) -> dict:
    """What is to be known of the files after a read: {path: {offset, size, modified, ends, from, turn, error}}.

    Files of the size and time that are known are not opened. Without a budget all complete lines are taken. from is where a read
    starts (the old offset, 0 of a new or rewritten file, whose generation grows); files that are gone are forgotten.
    """
    out, left = {}, budget
    turn = 1 + max((e["turn"] for e in known.values()), default=0)
    for path in sorted(files, key=lambda p: (known.get(p, {}).get("turn", 0), p)):
        (size, modified), old = files[path], known.get(path)
        same = old and (old["size"], old["modified"]) == (size, modified)
        if (same and (old["error"] or old["done"])) or (left is not None and left <= 0):
            if old:
                out[path] = old
            continue
        try:
            with _opened(path) as file:
                size = file.size()
                start, generation = (old["offset"], old["generation"]) if old else (0, 0)
                if start and (start > size or _ends(file, start) != old["ends"]):
                    start, generation = 0, generation + 1
                limit = size if left is None else min(size, start + left)
                offset = _line_end(file, start, limit, size)
                done = limit == size or offset > limit and _line_end(file, offset, size, size) == offset
                out[path] = {"offset": offset, "size": size, "modified": modified, "ends": _ends(file, offset), "generation": generation, "turn": turn if offset > start else (old or {}).get("turn", turn), "done": done, "error": None}
                if left is not None:
                    left -= offset - start
        except OSError as e:
            out[path] = {**(old or {"offset": 0, "ends": "", "generation": 0}), "size": size, "modified": modified, "turn": turn, "done": True, "error": f"{type(e).__name__}: {e}"[:300]}
    return out


def pieces(known: dict, wanted: dict, split: int = SPLIT_BYTES, numbers: dict[str, list[int]] | None = None, fatal: bool = False) -> list[Piece]:
    """The ranges to read between two states. numbers: of files in several ranges read from their beginning, lines before each."""
    out = []
    for path, new in sorted(wanted.items()):
        old = known.get(path)
        if new["error"]:
            if not old or old["error"] != new["error"] or old["modified"] != new["modified"]:
                out.append(Piece(path, 0, 0, 0, None, False, True, new["error"]))
            continue
        again = bool(old) and old["generation"] != new["generation"]
        start = old["offset"] if old and not again else 0
        if again and not new["offset"]:
            out.append(Piece(path, 0, 0, 0, None, True, True))  # nothing but that it was rewritten
        for n, at in enumerate(range(start, new["offset"], split)):
            before = (numbers or {}).get(path)
            first = before[n] if before and not start else 0 if not at else None
            out.append(Piece(path, at, min(at + split, new["offset"]), new["offset"], first, again, n == 0, gone_is_fatal=fatal))
    return out


def _lines(piece: Piece) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin in the piece, read a chunk at a time."""
    with _opened(piece.path) as file:
        at = piece.start if piece.at_line else piece.start - 1
        file.seek(at)
        held, skip = b"", not piece.at_line
        while at < piece.stop:
            content = file.read(min(CHUNK, piece.limit - at - len(held)))
            if not content:
                return
            held += content
            ends = held.rfind(b"\n") + 1
            for line in held[:ends].split(b"\n")[:-1]:
                if not skip:
                    if at >= piece.stop:
                        return
                    yield at, line
                skip = False
                at += len(line) + 1
            held = held[ends:]


def _rows(piece: Piece) -> Iterator[pa.RecordBatch]:
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    if piece.error or piece.stop <= piece.start:
        yield batch([(piece.path, None, None, None, None, piece.rewritten, piece.error)])
        return
    rows, number, size = [], piece.first_line, 0
    try:
        for at, line in _lines(piece):
            number = None if number is None else number + 1
            rows.append((piece.path, at, len(line) + 1, number, line.decode("utf-8", "replace").replace("\0", ""), piece.rewritten, None))
            size += len(line)
            if len(rows) >= BATCH_LINES or size >= 4 * CHUNK:
                yield batch(rows)
                rows, size = [], 0
    except OSError as e:
        if piece.gone_is_fatal and not isinstance(e, FileNotFoundError):
            raise  # the trigger fails and is read again
        rows.append((piece.path, None, None, None, None, piece.rewritten, f"{type(e).__name__}: {e}"[:300]))
    if rows:
        yield batch(rows)


class _Options:
    def __init__(self, options):
        self.root, self.pattern, self.strict = options["path"], options.get("pattern", "*.jsonl"), options.get("strict", "false") == "true"
        self.split, self.budget = int(options.get("split_bytes", SPLIT_BYTES)), int(options.get("trigger_bytes", TRIGGER_BYTES))
        self.known, self.wanted, self.numbers = (json.loads(options.get(n, "null")) for n in ("known", "wanted", "numbers"))

    def files(self) -> dict[str, tuple[int, int]]:
        return listed(self.root, self.pattern, self.strict)


class _Batch(DataSourceReader):
    def __init__(self, options: _Options):
        self.o = options

    def partitions(self) -> list[Piece]:
        wanted = self.o.wanted if self.o.wanted is not None else advanced(self.o.files(), {})
        return pieces(self.o.known or {}, wanted, self.o.split, self.o.numbers) or [Piece("", 0, 0, 0, None, False, True)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return _rows(partition) if partition.path else iter(())


class _Stream(DataSourceStreamReader):
    """Spark names the last offset to partitions(), also after a restart, before it asks for the next."""

    def __init__(self, options: _Options):
        self.o, self.last = options, {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        return {"files": json.dumps(advanced(self.o.files(), self.last, self.o.budget), sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        known, self.last = json.loads(start["files"]), json.loads(end["files"])
        return pieces(known, self.last, self.o.split, fatal=True)

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return _rows(partition)


class LogSource(DataSource):
    """Options: path (a folder of any store that Arrow opens), pattern, strict, split_bytes, trigger_bytes; known, wanted and numbers
    as log_lines gives them. In streams, and in batch for a file in several ranges without numbers, line_no may be null."""

    @classmethod
    def name(cls) -> str:
        return "agentlogs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(_Options(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(_Options(self.options))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many lines begin in each range."""
    for batch in batches:
        rows = [(p["path"], p["start"], sum(1 for _ in _lines(Piece(p["path"], p["start"], p["stop"], p["limit_"], None, False, p["at_line"])))) for p in batch.to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "start", "n"])


def log_lines(spark: SparkSession, root: str, known: dict | None = None, pattern: str = "*.jsonl", split_bytes: int = SPLIT_BYTES, strict: bool = False) -> tuple[DataFrame, dict]:
    """The lines that came since the state `known` (None: all), as LogSource's rows, and the state to give to the next call.

    Lines are numbered from 1 in files that are read from their beginning; ranges of a file that has several are counted first, by
    a job that gives the driver one number for each range. Driver and offsets grow with files and ranges, not with lines.
    """
    spark.dataSource.register(LogSource)
    before = known or {}
    wanted = advanced(listed(root, pattern, strict), before)
    many = [p for p in pieces(before, wanted, split_bytes) if not p.error and (p.start or p.stop < p.limit)]
    numbers: dict[str, list[int]] = {}
    if many:
        table = spark.createDataFrame([(p.path, p.start, p.stop, p.limit, p.at_line) for p in many], "path string, start long, stop long, limit_ long, at_line boolean")
        counts = table.repartition(len(many)).mapInArrow(_counted, "path string, start long, n long").collect()
        for path, _, n in sorted(map(tuple, counts)):
            numbers.setdefault(path, [0]).append(numbers[path][-1] + n)
    options = {"path": root, "pattern": pattern, "split_bytes": str(split_bytes), "known": json.dumps(before), "wanted": json.dumps(wanted), "numbers": json.dumps(numbers)}
    return spark.read.format("agentlogs").options(**options).load(), wanted


def load_errors(lines: DataFrame) -> DataFrame:
    """One issue row for each file that couldn't be read."""
    return lines.filter(F.col("error").isNotNull()).select("path", F.lit("load_error").alias("issue"), F.col("error").alias("excerpt"))


def stale_paths(lines: DataFrame) -> DataFrame:
    """Paths of rewritten files: rows of earlier reads of them go (an anti join on path)."""
    return lines.filter("rewritten").select("path").distinct()
