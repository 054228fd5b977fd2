"""WARC files to capture records: what loomlog.llm.revisits resolves.

Files are read by Spark's binaryFile source, one task each (so a file has at most 2 GB as it lies); compressed files are gzip
members one after another, as the format asks. They are inflated a piece at a time, and one record is held at a time. Only HTTP
responses and server-not-modified revisits are captures; other records are passed over. A record without a length is skipped
to the next one that begins a line; what is cut off or broken ends its file. read_issues counts both.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

NOT_MODIFIED = "server-not-modified"
CAPTURES = "record_id long, warc_id string, url string, captured long, kind string, http_status int, headers map<string,string>, body binary, body_sha256 string"


#: Bytes that are inflated at a time.
PIECE = 1 << 20


def plain_pieces(content: bytes) -> Iterator[bytes]:
    """The content of a plain or gzip file, piece by piece; a broken member raises zlib.error."""
    view, at = memoryview(content), 0
    if content[:2] != b"\x1f\x8b":
        while at < len(view):
            yield bytes(view[at : at + PIECE])
            at += PIECE
        return
    while at < len(view):
        member = zlib.decompressobj(31)
        while not member.eof and at < len(view):
            piece = view[at : at + PIECE]
            data = member.decompress(piece, PIECE)
            at += len(piece)
            while data:
                yield data
                data = b"" if member.eof else member.decompress(member.unconsumed_tail, PIECE)
            at -= len(member.unused_data)
        if not member.eof:
            raise zlib.error("cut off")
        while at < len(view) and view[at] == 0:  # padding between members
            at += 1


def header_map(block: bytes) -> dict[str, str]:
    """Names as given; a repeated name's values are joined by a comma."""
    out: dict[str, str] = {}
    for line in block.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            key, text = name.decode("latin-1").strip(), value.decode("utf-8", "replace").strip()
            out[key] = f"{out[key]}, {text}" if key in out else text
    return out


def entries(content: bytes) -> Iterator[tuple[dict[str, str], bytes] | str]:
    """(WARC header, block) of each whole record, and in its place a word for what can't be read: no_length or broken."""
    pieces, held = plain_pieces(content), bytearray()

    def more() -> bool:
        try:
            held.extend(next(pieces))
        except StopIteration:
            return False
        return True

    try:
        while True:
            while (begin := held.find(b"WARC/")) < 0:
                del held[: max(0, len(held) - 4)]
                if not more():
                    return
            del held[:begin]
            while (end := held.find(b"\r\n\r\n")) < 0:
                if not more():
                    yield "broken"
                    return
            head = {k.lower(): v for k, v in header_map(bytes(held[:end])).items()}
            length = head.get("content-length", "")
            if not length.isdigit():
                yield "no_length"
                while (nxt := held.find(b"\nWARC/", end)) < 0:
                    if not more():
                        return
                del held[: nxt + 1]
                continue
            to = end + 4 + int(length)
            while len(held) < to:
                if not more():
                    yield "broken"
                    return
            yield head, bytes(held[end + 4 : to])
            del held[:to]
    except zlib.error:
        yield "broken"


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(WARC header, block) of each whole record."""
    return (e for e in entries(content) if not isinstance(e, str))


def capture(head: dict[str, str], block: bytes) -> dict | None:
    kind = head.get("warc-type")
    if kind == "revisit" and NOT_MODIFIED not in head.get("warc-profile", ""):
        return None
    if kind not in ("response", "revisit"):
        return None
    status_line, _, rest = block.partition(b"\r\n")
    http, _, body = rest.partition(b"\r\n\r\n")
    status = status_line.split(b" ")[1:2]
    try:
        when = int(dt.datetime.fromisoformat(head["warc-date"]).timestamp() * 1_000_000)
    except (KeyError, ValueError):
        when = None
    full = kind == "response"
    return {
        "record_id": xxhash.xxh3_64_intdigest(head.get("warc-record-id", "").encode()) - 2**63,
        "warc_id": head.get("warc-record-id"),
        "url": head.get("warc-target-uri", "").strip("<>") or None,
        "captured": when,
        "kind": kind,
        "http_status": int(status[0]) if status and status[0].isdigit() else None,
        "headers": list(header_map(http).items()),
        "body": body if full else None,
        "body_sha256": hashlib.sha256(body).hexdigest() if full else None,
    }


_SCHEMA = pa.schema([("record_id", pa.int64()), ("warc_id", pa.string()), ("url", pa.string()), ("captured", pa.int64()), ("kind", pa.string()), ("http_status", pa.int32()), ("headers", pa.map_(pa.string(), pa.string())), ("body", pa.binary()), ("body_sha256", pa.string())])


def _captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            held, size = [], 0
            for head, block in records(content.as_py() or b""):
                if found := capture(head, block):
                    held.append(found)
                    size += len(block)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_pylist(held, _SCHEMA)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, _SCHEMA)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all WARC files below a path. record_id is a hash of WARC-Record-ID, captured microseconds since 1970."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(_captures, CAPTURES)


def _issues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            counts = {"no_length": 0, "broken": 0}
            n = 0
            for e in entries(content.as_py() or b""):
                if isinstance(e, str):
                    counts[e] += 1
                n += 1
            rows.append({"path": path, "records": n - sum(counts.values()), **counts})
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), *((c, pa.int64()) for c in ("records", "no_length", "broken"))]))


def read_issues(spark: SparkSession, path: str) -> DataFrame:
    """For each WARC file below a path how many records it has, and how many couldn't be read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(_issues, "path string, records long, no_length long, broken long")
