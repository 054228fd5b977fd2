"""Append-only JSON-lines logs with the byte position of every record, from any store that Spark reads.

A first read goes through Spark's text source, split by split, so files may be of any size. What has changed since an earlier
read is found by its binaryFile source, one task for a changed file, as both ends of the old part are checked. Only complete
lines count; a tail without a newline waits for the next read, and NULs at the end (a crash's padding) are no lag.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of either end of what was read that a later read checks.
CHECKED = 65_536
#: A tail of at most so many NULs is padding.
PADDING = 1 << 20

LINES = "path string, byte_offset long, byte_length long, line_no long, raw string"
CHANGES = LINES + ", rewritten boolean"
STATE = "path string, size long, offset long, lines long, head_sha string, tail_sha string, padding long, modified long"


def digest(content: bytes, end: int) -> tuple[str, str]:
    """SHA-256 of the first and of the last CHECKED bytes before end."""
    return hashlib.sha256(content[: min(end, CHECKED)]).hexdigest(), hashlib.sha256(content[max(0, end - CHECKED) : end]).hexdigest()


def split_lines(content: bytes, start: int = 0, line_no: int = 0) -> Iterator[tuple[int, int, int, bytes]]:
    """(offset, length with newline, number from line_no + 1, bytes) of each complete line from start on."""
    at = start
    while (end := content.find(b"\n", at)) >= 0:
        line_no += 1
        yield at, end + 1 - at, line_no, content[at:end]
        at = end + 1


def padding(content: bytes, end: int) -> int:
    """How many NULs follow the last complete line, if nothing else does."""
    tail = content[end:]
    return len(tail) if 0 < len(tail) <= PADDING and not tail.strip(b"\0") else 0


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            content, start = row["content"] or b"", row["offset"] or 0
            grown = start and start <= len(content) and digest(content, start) == (row["head_sha"], row["tail_sha"])
            found = list(split_lines(content, start, row["lines"] or 0) if grown else split_lines(content))
            lost = bool(start and not grown)
            if lost and not found:
                found = [(None, None, None, b"")]
            columns = [[row["path"]] * len(found), *([x[i] for x in found] for i in range(3)), [x[3].decode("utf-8", "replace").replace("\0", "") for x in found], [lost] * len(found)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()), strict=True)], ["path", "byte_offset", "byte_length", "line_no", "raw", "rewritten"])


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            content = row["content"] or b""
            end = content.rfind(b"\n") + 1
            rows.append({"path": row["path"], "size": len(content), "offset": end, "lines": content.count(b"\n"), **dict(zip(("head_sha", "tail_sha"), digest(content, end), strict=True)), "padding": padding(content, end), "modified": row["modified"]})
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), *((n, pa.int64()) for n in ("size", "offset", "lines")), ("head_sha", pa.string()), ("tail_sha", pa.string()), ("padding", pa.int64()), ("modified", pa.int64())]))


def files(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)


def file_states(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    """What a read of the files has seen: the state that the next read starts from."""
    return files(spark, root, pattern).select("path", "content", F.unix_micros("modificationTime").alias("modified")).mapInArrow(_states, STATE)


def read_changes(spark: SparkSession, root: str, state: DataFrame | None = None, pattern: str = "*.jsonl") -> DataFrame:
    """Every complete line with its position, and whether its file was rewritten. With the state of an earlier read, only what
    came since: a file of the same size and time is left out before it is read, a grown one is read from its offset if both
    ends of the old part are unchanged, and a rewritten or shorter one is read anew: the old rows of its path are then to be
    purged (by an anti join on the paths marked rewritten). One without lines has one row, of nulls and an empty raw.
    Spark doesn't list files of no bytes, so one emptied to nothing is not told from one that is gone."""
    found = files(spark, root, pattern).withColumn("_modified", F.unix_micros("modificationTime"))
    if state is None:
        given = found.select("path", "content", F.lit(None).cast("long").alias("offset"), F.lit(None).cast("long").alias("lines"), F.lit(None).cast("string").alias("head_sha"), F.lit(None).cast("string").alias("tail_sha"))
    else:
        modified = F.col("modified") if "modified" in state.columns else F.lit(None).cast("long").alias("modified")
        known = state.select("path", "size", "offset", "lines", "head_sha", "tail_sha", modified)
        same = (F.col("length") == F.col("size")) & (F.col("_modified") == F.col("modified"))
        changed = found.select("path", "length", "_modified").join(known, "path", "left").filter(~F.coalesce(same, F.lit(False))).drop("length", "size", "_modified", "modified")
        given = found.select("path", "content").join(changed, "path")
    return given.select("path", "content", "offset", "lines", "head_sha", "tail_sha").mapInArrow(_lines, CHANGES)


def all_lines(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    """Every complete line with its position, of files of any size: Spark's text source reads them split by split.

    A split's lines are numbered and their bytes summed within the split, the splits' totals within the file, so no task holds
    more than a split. A last line without its end reaches beyond the file's size and is left out.
    """
    text = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root)
    path = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/")
    rows = text.select(path.alias("path"), F.col("_metadata.file_size").alias("_size"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), (F.octet_length("value") + 1).cast("long").alias("byte_length"), F.replace(F.make_valid_utf8("value"), F.lit("\0"), F.lit("")).alias("raw"))
    earlier = Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("path", "_block").agg(F.sum("byte_length").alias("_bytes"), F.count("*").alias("_lines"))
    starts = blocks.select("path", "_block", F.coalesce(F.sum("_bytes").over(earlier), F.lit(0)).alias("_bytes"), F.coalesce(F.sum("_lines").over(earlier), F.lit(0)).alias("_lines"))
    inside = Window.partitionBy("path", "_block").orderBy("_at")
    placed = rows.withColumns({"_before": F.coalesce(F.sum("byte_length").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_n": F.row_number().over(inside)}).join(starts, ["path", "_block"])
    out = placed.withColumns({"byte_offset": F.col("_bytes") + F.col("_before"), "line_no": F.col("_lines") + F.col("_n")})
    return out.filter(F.col("byte_offset") + F.col("byte_length") <= F.col("_size")).select("path", "byte_offset", "byte_length", "line_no", "raw")


def read_lines(spark: SparkSession, root: str, state: DataFrame | None = None, pattern: str = "*.jsonl") -> DataFrame:
    """All lines, or with the state of an earlier read those of read_changes alone."""
    if state is None:
        return all_lines(spark, root, pattern)
    return read_changes(spark, root, state, pattern).filter("byte_offset IS NOT NULL").drop("rewritten")


def rewritten(old: DataFrame, new: DataFrame) -> DataFrame:
    """Paths whose old part changed, as far as two states tell: shorter ones, others by their heads from CHECKED bytes on, and
    those of equal length by both ends. What read_changes marks is exact at every size."""
    o = old.select("path", F.col("offset").alias("_o"), F.col("head_sha").alias("_h"), F.col("tail_sha").alias("_t"))
    head = (F.col("_o") >= CHECKED) & (F.col("head_sha") != F.col("_h"))
    ends = (F.col("offset") == F.col("_o")) & ((F.col("head_sha") != F.col("_h")) | (F.col("tail_sha") != F.col("_t")))
    return new.join(o, "path").filter((F.col("offset") < F.col("_o")) | head | ends).select("path")


def file_role(path: Column) -> Column:
    """The role that the shape of a path gives a file."""
    shapes = (
        ("workflow_journal", r"/subagents/workflows/[^/]+/journal\.jsonl$"),
        ("workflow_agent", r"/subagents/workflows/[^/]+/agent-[^/]+\.jsonl$"),
        ("claude_subagent_meta", r"/subagents/agent-[^/]+\.meta\.json$"),
        ("subagent", r"/subagents/agent-[^/]+\.jsonl$|/run-[0-9]+/session\.jsonl$"),
        ("pi_artifact", r"/subagent-artifacts/[^/]+_transcript\.jsonl$"),
        ("pi_progress", r"/progress/[^/]+\.json$"),
        ("main", r"\.jsonl$"),
    )
    role = F
    for name, pattern in shapes:
        role = role.when(path.rlike(pattern), name)
    return role


def inventory(hot: DataFrame, cold: DataFrame, hot_root: str, cold_root: str) -> DataFrame:
    """One row per logical file of two tiers (path, length, modificationTime each): the hot copy where there are both."""
    tier = lambda df, root, name, rank: df.select(F.regexp_replace("path", "^" + re.escape(root.rstrip("/")) + "/", "").alias("rel_path"), "path", "length", "modificationTime", F.lit(name).alias("tier"), F.lit(rank).alias("rank"))
    both = tier(hot, hot_root, "hot", 0).unionByName(tier(cold, cold_root, "cold", 1))
    chosen = both.groupBy("rel_path").agg(F.min_by(F.struct("path", "length", "modificationTime", "tier"), "rank").alias("f"), F.count("*").alias("copies"))
    return chosen.select("rel_path", "f.*", "copies", F.split("rel_path", "/")[0].alias("namespace"), file_role(F.col("f.path")).alias("role"))


def parsed(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines that are JSON objects, and an issue row (json_error or not_object) for each that isn't: nothing is fatal."""
    v = lines.withColumn("_kind", F.when(F.trim("raw") == "", "blank").when(F.try_parse_json("raw").isNull(), "json_error").when(~F.ltrim("raw").startswith("{"), "not_object"))
    good = v.filter("_kind IS NULL").drop("_kind")
    return good, v.filter("_kind IN ('json_error', 'not_object')").select("path", "byte_offset", "line_no", F.col("_kind").alias("issue"), F.left("raw", F.lit(200)).alias("excerpt"))
