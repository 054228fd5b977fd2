"""Further records of the session logs: hooks, compactions, rate limits, and a census of record types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _at(path: str):
    return F.get_json_object("raw", path)


def record_census(lines: DataFrame) -> DataFrame:
    """How often each record type was seen, and where first and last: unknown types are counted, never fatal."""
    kind = F.coalesce(_at("$.type"), F.lit("(none)"))
    sub = F.coalesce(_at("$.payload.type"), _at("$.subtype"), _at("$.attachment.type"), F.lit(""))
    return lines.groupBy(kind.alias("type"), sub.alias("subtype")).agg(F.count("*").alias("n"), F.min(F.struct("path", "byte_offset")).alias("first"), F.max(F.struct("path", "byte_offset")).alias("last"))


def merged_census(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two censuses in one: counts add, extremes stay."""
    return old.unionByName(new).groupBy("type", "subtype").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))


def hook_events(lines: DataFrame) -> DataFrame:
    """Runs of hooks in claude logs: name, event, how they ended and how long they took."""
    a = lambda name: _at(f"$.attachment.{name}")
    return lines.filter(F.coalesce(a("type"), F.lit("")).startswith("hook")).select(
        _at("$.sessionId").alias("session_uid"), F.try_to_timestamp(_at("$.timestamp")).alias("ts"), a("hookName").alias("hook_name"), a("hookEvent").alias("hook_event"),
        a("type").alias("outcome"), a("exitCode").try_cast("int").alias("exit_code"), a("durationMs").try_cast("long").alias("duration_ms"), a("toolUseID").alias("call_uid"), "path", "byte_offset",
    )


def compactions(lines: DataFrame) -> DataFrame:
    """Where a session's context was folded, in any harness."""
    found = ((_at("$.type") == "system") & (_at("$.subtype") == "compact_boundary")) | _at("$.type").isin("compacted", "compaction")
    return lines.filter(found).select(F.try_to_timestamp(_at("$.timestamp")).alias("ts"), F.coalesce(_at("$.compactMetadata.trigger"), _at("$.payload.trigger")).alias("trigger"), F.coalesce(_at("$.compactMetadata.preTokens"), _at("$.tokensBefore")).try_cast("long").alias("tokens_before"), "path", "byte_offset")


def rate_limit_samples(lines: DataFrame) -> DataFrame:
    """One row for each window of a codex rate-limit record."""
    sample = lines.filter((_at("$.payload.type") == "token_count") & _at("$.payload.rate_limits").isNotNull())
    one = lambda kind: F.struct(F.lit(kind).alias("window_kind"), _at(f"$.payload.rate_limits.{kind}.used_percent").try_cast("double").alias("used_percent"), _at(f"$.payload.rate_limits.{kind}.window_minutes").try_cast("long").alias("window_minutes"))
    return sample.select(F.try_to_timestamp(_at("$.timestamp")).alias("ts"), "path", "byte_offset", F.inline(F.array(one("primary"), one("secondary")))).filter("used_percent IS NOT NULL")


def forecast(samples: DataFrame, hours: int = 6) -> DataFrame:
    """The latest sample of each window, percent burnt an hour over the last hours, and when 100 is reached at that rate.

    A window that was reset in between (usage fell) burns nothing that can be told.
    """
    newest = samples.groupBy("window_kind").agg(F.max_by(F.struct("ts", "used_percent"), F.struct("ts", "byte_offset")).alias("l"))
    near = samples.join(newest, "window_kind").filter(F.unix_micros(F.col("l.ts")) - F.unix_micros("ts") <= hours * 3_600_000_000)
    r = near.groupBy("window_kind").agg(F.first("l").alias("l"), F.min_by("used_percent", F.struct("ts", "byte_offset")).alias("begin"), F.min("ts").alias("since"))
    span = (F.unix_micros(F.col("l.ts")) - F.unix_micros("since")) / 3_600_000_000
    burn = F.when((span > 0) & (F.col("l.used_percent") >= F.col("begin")), (F.col("l.used_percent") - F.col("begin")) / span)
    left = F.when(burn > 0, (100 - F.col("l.used_percent")) / burn)
    return r.select("window_kind", F.col("l.ts").alias("ts"), F.col("l.used_percent").alias("used_percent"), burn.alias("burn_per_hour"), left.alias("hours_left"))
