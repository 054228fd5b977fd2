"""Views over the session catalogue (the tables of loomlog.sources.transcripts): functions of DataFrames and parameters.

Filters are added only where a parameter is given, so they reach the scan. Times that the reference takes from the clock are
parameters here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomlog.functions import classify, names
from loomlog.operators import lineage, temporal

TOKENS = ("input_tokens", "cached_tokens", "cache_write_tokens", "output_tokens")


def scoped(df: DataFrame, at: str = "ts", since=None, until=None, agents: Sequence[str] | None = None) -> DataFrame:
    """df within [since, until) and of the given harnesses; what isn't given isn't filtered."""
    if since is not None:
        df = df.filter(F.col(at) >= F.lit(since))
    if until is not None:
        df = df.filter(F.col(at) < F.lit(until))
    return df.filter(F.col("agent").isin(*agents)) if agents is not None else df


def with_price(usage: DataFrame, prices: DataFrame, model: str = "model", day: str = "day") -> DataFrame:
    """usage (TOKENS and, if there is one, cache_write_1h_tokens) with usd at the price of its model and day, null if it has none.

    An absent price of cached input is that of input; of a cache write of an hour that of the usual one, then that of input.
    """
    found = temporal.valid_at(usage, prices, model, day, "effective_from")
    t = lambda c: F.coalesce(F.col(c), F.lit(0))
    write = F.coalesce("cache_write", "input")
    usd = t("input_tokens") * F.col("input") + t("cached_tokens") * F.coalesce("cached", "input") + t("cache_write_tokens") * write + t("output_tokens") * F.col("output")
    if "cache_write_1h_tokens" in usage.columns:
        usd = usd + t("cache_write_1h_tokens") * (F.coalesce("cache_write_1h", write) if "cache_write_1h" in prices.columns else write)
    return found.withColumn("usd", usd / 1e6).drop("input", "cached", "cache_write", "cache_write_1h", "output")


def priced(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """calls grouped by (agent, session, model, UTC day) with tokens and usd; unpriced models have null.

    prices: model, effective_from (date), input, cached, cache_write, output per million tokens; an absent cached or write
    price is the input price.
    """
    daily = calls.groupBy("agent", "session_uid", "model", F.to_date("ts").alias("day")).agg(F.count("*").alias("calls"), *[F.sum(c).alias(c) for c in TOKENS])
    return with_price(daily, prices)


def session_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """usd and unpriced calls by session: priced once a group, then summed."""
    return priced(calls, prices).groupBy("agent", "session_uid").agg(F.sum("usd").alias("usd"), F.sum("calls").alias("calls"), F.sum(F.when(F.col("usd").isNull(), F.col("calls")).otherwise(0)).alias("unpriced_calls"))


def daily_usage(calls: DataFrame, prices: DataFrame, **scope) -> DataFrame:
    return priced(scoped(calls, **scope), prices).groupBy("day", "agent", "model").agg(*[F.sum(c).alias(c) for c in TOKENS], F.sum("usd").alias("usd"), F.sum("calls").alias("calls"))


def cost_report(calls: DataFrame, prices: DataFrame, **scope) -> DataFrame:
    """Usage by day and model, by day, and in all."""
    sets = daily_usage(calls, prices, **scope).groupingSets([["day", "agent", "model"], ["day"], []], "day", "agent", "model")
    return sets.agg(F.sum("usd").alias("usd"), F.sum("calls").alias("calls"))


def tool_reliability(tool_calls: DataFrame, **scope) -> DataFrame:
    """Calls, error rate and latency percentiles by tool."""
    ms = (F.unix_micros("result_ts") - F.unix_micros("ts")) / 1000
    return scoped(tool_calls, **scope).withColumn("ms", ms).groupBy("agent", "tool_name").agg(F.count("*").alias("calls"), F.round(F.avg(F.col("is_error").cast("int")), 4).alias("error_rate"), F.percentile("ms", 0.5).alias("p50_ms"), F.percentile("ms", 0.95).alias("p95_ms"))


def with_failures(tool_calls: DataFrame) -> DataFrame:
    """tool_calls with the excerpt and class of a failure."""
    none = lambda kind: F.lit(None).cast(kind)
    excerpt = classify.error_excerpt(none("string"), F.col("output"))
    shown = tool_calls.withColumn("error_excerpt", F.when(F.col("is_error"), excerpt))
    return shown.withColumn("error_class", classify.failure_class(none("string"), none("boolean"), none("boolean"), none("int"), F.col("is_error"), none("string"), F.col("error_excerpt")))


def call_triggers(calls: DataFrame, tool_calls: DataFrame, messages: DataFrame) -> DataFrame:
    """Each model call with what set it off: the class of the last tool result or prompt before it in its source."""
    key = ["agent", "session_uid", "path", "byte_offset"]
    call = calls.select(*key, F.lit(None).cast("string").alias("trig"), F.col("response_id"))
    tool = tool_calls.filter("result_ts IS NOT NULL").select(*key, classify.result_class(F.col("agent"), F.col("tool_name"), F.col("args"), F.col("output")).alias("trig"), F.lit(None).cast("string").alias("response_id"))
    prompt = messages.filter("message_class = 'human_prompt'").select(*key, F.lit("human").alias("trig"), F.lit(None).cast("string").alias("response_id"))
    w = Window.partitionBy("agent", "session_uid").orderBy("path", "byte_offset", F.col("response_id").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    events = call.unionByName(tool).unionByName(prompt)
    return events.withColumn("trigger", F.last("trig", ignorenulls=True).over(w)).filter("response_id IS NOT NULL").select("agent", "session_uid", "response_id", F.coalesce("trigger", F.lit("start")).alias("trigger"))


def efficiency(calls: DataFrame, tool_calls: DataFrame, messages: DataFrame) -> DataFrame:
    """Calls by trigger and the share that polling (wait, status, noop) set off, by session."""
    t = call_triggers(calls, tool_calls, messages)
    share = lambda *kinds: F.count_if(F.col("trigger").isin(*kinds))
    return t.groupBy("agent", "session_uid").agg(F.count("*").alias("calls"), share("wait", "status", "noop").alias("polls"), share("work").alias("work"), share("human").alias("human"), F.round(share("wait", "status", "noop") / F.count("*"), 4).alias("poll_share"))


def timeline(messages: DataFrame, tool_calls: DataFrame, calls: DataFrame, session_uid: str, limit: int = 500, width: int = 200) -> DataFrame:
    """One session's messages, tool calls and model calls in physical order."""
    cut = lambda c: F.left(c, F.lit(width))
    parts = [
        messages.select("session_uid", "path", "byte_offset", "ts", F.col("message_class").alias("kind"), cut("text").alias("what")),
        tool_calls.select("session_uid", "path", "byte_offset", "ts", F.lit("tool").alias("kind"), F.concat_ws(" ", "tool_name", cut("args")).alias("what")),
        calls.select("session_uid", "path", "byte_offset", "ts", F.lit("call").alias("kind"), F.col("model").alias("what")),
    ]
    own = parts[0].unionByName(parts[1]).unionByName(parts[2]).filter(F.col("session_uid") == session_uid)
    return own.orderBy("path", "byte_offset", "kind", "what").limit(limit)


def rollup(sessions: DataFrame, messages: DataFrame, calls: DataFrame, tool_calls: DataFrame, dirty: DataFrame | None = None) -> DataFrame:
    """One row per session with the totals of every fact table, each aggregated alone; with dirty (agent, session_uid) only those."""
    key = ["agent", "session_uid"]
    if dirty is not None:
        sessions, messages, calls, tool_calls = (df.join(dirty, key, "left_semi") for df in (sessions, messages, calls, tool_calls))
    said = messages.groupBy(*key).agg(F.count_if(F.col("message_class") == "human_prompt").alias("prompts"), F.count("*").alias("messages"), F.min_by("text", F.when(F.col("message_class") == "human_prompt", F.struct("path", "byte_offset"))).alias("first_prompt"))
    made = calls.groupBy(*key).agg(F.count("*").alias("calls"), *[F.sum(c).alias(c) for c in TOKENS], F.array_sort(F.collect_set("model")).alias("models"))
    used = tool_calls.groupBy(*key).agg(F.count("*").alias("tool_calls"), F.count_if("is_error").alias("tool_errors"))
    active = temporal.active_seconds(messages.select(*key, "ts", "event_uid"), key, "ts", "event_uid")
    out = sessions
    for part in (said, made, used, active):
        out = out.join(part, key, "left")
    counts = ["prompts", "messages", "calls", "tool_calls", "tool_errors", "active_seconds"]
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in counts}).withColumn("project", names.project_of(F.col("cwd")))


def session_tree(sessions: DataFrame, rolled: DataFrame, max_depth: int = lineage.MAX_DEPTH) -> DataFrame:
    """Totals of each root session over its descendants, up to max_depth steps below it; those of deeper ones and of cycles by a null root."""
    tops = lineage.roots(sessions, "session_uid", "parent_uid", max_depth)
    return rolled.join(tops, "session_uid").groupBy("root").agg(F.count("*").alias("sessions"), F.max("depth").alias("depth"), F.sum("calls").alias("calls"), F.sum("output_tokens").alias("output_tokens"), F.sum("tool_calls").alias("tool_calls"))


def roles(sessions: DataFrame) -> DataFrame:
    """sessions (session_uid, parent_uid) with role: worker (it has a parent), root (others have it as parent), else solo."""
    parents = sessions.filter("parent_uid IS NOT NULL").select(F.col("parent_uid").alias("session_uid"), F.lit(True).alias("_has")).distinct()
    role = F.when(F.col("parent_uid").isNotNull(), "worker").when(F.col("_has"), "root").otherwise("solo")
    return sessions.join(parents, "session_uid", "left").withColumn("role", role).drop("_has")
