"""Records from git's output, task files and landing ledgers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def numstat(text: Column) -> Column:
    """array<struct<sha, files, insertions, deletions>> of a log of record marks (\\x1e, hash) with numstat lines; binary files have no lines."""
    line_of = lambda block: F.filter(F.split(block, "\n"), lambda x: F.size(F.split(x, "\t")) >= 3)
    number = lambda x, i: F.coalesce(F.split(x, "\t")[i].try_cast("long"), F.lit(0))
    total = lambda block, i: F.aggregate(line_of(block), F.lit(0).cast("long"), lambda s, x: s + number(x, i))
    blocks = F.slice(F.split(text, "\x1e"), 2, F.size(F.split(text, "\x1e")))
    return F.transform(blocks, lambda b: F.struct(F.trim(F.split(b, "\n")[0]).alias("sha"), F.size(line_of(b)).alias("files"), total(b, 0).alias("insertions"), total(b, 1).alias("deletions")))


def commits_in_output(output: Column) -> Column:
    """array of abbreviated hashes that a commit command's output names."""
    return F.regexp_extract_all(output, F.lit(r"(?m)^\[[^\]\n]*?([0-9a-f]{7,40})\]"), F.lit(1))


def reverted(body: Column) -> Column:
    return F.nullif(F.regexp_extract(body, r"(?i)this reverts commit ([0-9a-f]{7,40})", 1), F.lit(""))


def front_matter(text: str) -> dict | None:
    """The block of key: value lines between two lines of three hyphens at the head; lists inline or as hyphen lines, folded text after > or |."""
    m = re.match(r"﻿?---[ \t]*\r?\n(.*?)^---[ \t]*\r?$", text or "", re.S | re.M)
    if not m:
        return None
    bare = lambda s: s.strip().strip("\"'") if s.strip() not in ("", "null", "~") else None
    out: dict = {}
    key = mode = None
    for line in m[1].replace("\r", "").split("\n"):
        if (k := re.match(r"([A-Za-z_][\w-]*):\s*(.*?)\s*$", line)) and not line[:1].isspace():
            key, value = k[1], k[2]
            mode = None
            if value.startswith("[") and value.endswith("]"):
                out[key] = [x for x in map(bare, value[1:-1].split(",")) if x is not None]
            elif value[:1] in (">", "|") and value:
                out[key], mode = "", "text"
            elif value:
                out[key] = bare(value)
            else:
                out[key], mode = None, "list"
        elif mode == "text" and line.strip():
            out[key] = f"{out[key]} {line.strip()}".strip()
        elif mode == "list" and (item := re.match(r"\s*-\s+(.*)", line)):
            out[key] = [*(out[key] or []), *([x] if (x := bare(item[1])) is not None else [])]
        elif mode == "list" and line.startswith("   ") and line.strip() and out[key]:
            out[key][-1] += " " + line.strip()
    return out


def landings(events: DataFrame) -> DataFrame:
    """One row per landing of a ledger (n: order; event, outcome, pr, head, issues, fix_forward, slot_seconds).

    A landing is its pull request, or its head where there is none. Its state is the last event's; it landed if it was merged
    or verified, and those events name its issues.
    """
    key = F.when(F.col("pr").isNotNull(), F.concat(F.lit("pr:"), F.col("pr").cast("string"))).when(F.col("head") != "", F.concat(F.lit("head:"), F.col("head")))
    last = lambda value, when: F.max_by(value, F.when(when, F.col("n")))
    landed = F.col("event").isin("merged", "verified")
    go = (F.col("event") == "ready") & (F.col("outcome") == "go")
    return (
        events.withColumn("landing", key)
        .filter("landing IS NOT NULL")
        .groupBy("landing")
        .agg(
            F.min("n").alias("first_seen"),
            last(F.coalesce("outcome", "event"), F.lit(True)).alias("outcome"),
            last(F.col("head"), F.coalesce(F.col("head") != "", F.lit(False))).alias("head"),
            F.bool_or(landed).alias("landed"),
            F.coalesce(last(F.col("fix_forward").isNotNull(), go), F.lit(False)).alias("fix_forward"),
            last(F.col("slot_seconds"), F.col("slot_seconds").isNotNull()).alias("slot_seconds"),
            F.array_distinct(F.flatten(F.array_sort(F.collect_list(F.when(landed & F.col("issues").isNotNull(), F.struct("n", "issues")))).getField("issues"))).alias("issues"),
        )
    )
