"""Typed rows from the session logs of three agent harnesses, by JSON expressions on the lines: no Python per record.

Every function takes lines (path, byte_offset, line_no, raw) of one harness and returns tables of the same columns for all
three: sessions, messages, calls (of models), tool_calls. The physical order (path, byte_offset) is the order of events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = "array<struct<type:string,text:string,thinking:string,id:string,name:string,input:string,tool_use_id:string,content:string,is_error:boolean,arguments:string>>"


def _at(path: str) -> Column:
    return F.get_json_object("raw", path)


def _time(path: str = "$.timestamp") -> Column:
    return F.try_to_timestamp(_at(path))


def _number(path: str) -> Column:
    return F.expr(f"try_cast(get_json_object(raw, '{path}') AS BIGINT)")


def known_usage(calls: DataFrame) -> DataFrame:
    """Calls whose usage is zero throughout and that have no stop reason: their usage is unknown, not zero."""
    tokens = ["input_tokens", "cached_tokens", "cache_write_tokens", "output_tokens"]
    zero = F.col("stop_reason").isNull()
    for c in tokens:
        zero = zero & (F.coalesce(F.col(c), F.lit(0)) == 0)
    return calls.withColumns({c: F.when(~zero, F.col(c)) for c in tokens})


def _calls(rows: DataFrame) -> DataFrame:
    """One row per response: a response may be split over lines, which repeat growing usage, so the largest counts."""
    tokens = ["input_tokens", "cached_tokens", "cache_write_tokens", "output_tokens"]
    merged = rows.groupBy("agent", "session_uid", "response_id").agg(
        F.min("ts").alias("ts"), F.max("model").alias("model"), F.max_by("stop_reason", F.when(F.col("stop_reason").isNotNull(), F.col("byte_offset"))).alias("stop_reason"),
        *[F.max(c).alias(c) for c in tokens], F.min("byte_offset").alias("byte_offset"), F.min("path").alias("path"),
    )
    return known_usage(merged)


def _tools(uses: DataFrame, results: DataFrame) -> DataFrame:
    """Tool calls with their results; the first result of a call counts."""
    first = results.groupBy("call_uid").agg(F.min_by(F.struct("result_ts", "is_error", "output"), "byte_offset").alias("r"))
    return uses.dropDuplicates(["session_uid", "call_uid"]).join(first, "call_uid", "left").select("agent", "session_uid", "call_uid", "tool_name", "args", "ts", "path", "byte_offset", F.col("r.result_ts").alias("result_ts"), F.col("r.is_error").alias("is_error"), F.col("r.output").alias("output"))


def _sessions(rows: DataFrame) -> DataFrame:
    """One row per session: extremes of time, the first known folder and branch, the number of records."""
    kept = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("path", "byte_offset"))).alias(c)
    return rows.groupBy("agent", "session_uid").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), kept("cwd"), kept("git_branch"), kept("parent_uid"), F.count("*").alias("records"))


def claude(lines: DataFrame) -> dict[str, DataFrame]:
    rows = lines.select(
        "path", "byte_offset", F.lit("claude").alias("agent"), _at("$.type").alias("type"), _at("$.sessionId").alias("session_uid"), _time().alias("ts"), _at("$.uuid").alias("event_uid"),
        _at("$.cwd").alias("cwd"), _at("$.gitBranch").alias("git_branch"), F.lit(None).cast("string").alias("parent_uid"), _at("$.origin.kind").alias("origin"), "raw",
    ).filter("session_uid IS NOT NULL")
    content = _at("$.message.content")
    blocks = F.when(F.ltrim(content).startswith("["), F.from_json(content, BLOCK)).otherwise(F.array(F.from_json(F.to_json(F.struct(F.lit("text").alias("type"), content.alias("text"))), BLOCK[6:-1])))
    spoken = rows.filter("type IN ('user', 'assistant')").select("*", F.posexplode(blocks).alias("block_no", "b"))
    messages = spoken.filter("b.type IN ('text', 'thinking')").select(
        "agent", "session_uid", F.concat_ws("#", "event_uid", "block_no").alias("event_uid"), "ts", F.col("type").alias("role"),
        F.when(F.col("type") == "user", F.when(F.coalesce("origin", F.lit("typed")).isin("typed", "pasted", "human"), "human_prompt").otherwise("injected")).when(F.col("b.type") == "thinking", "thinking").otherwise("assistant_text").alias("message_class"),
        F.coalesce("b.text", "b.thinking").alias("text"), "path", "byte_offset",
    )
    calls = rows.filter("type = 'assistant'").select("agent", "session_uid", _at("$.message.id").alias("response_id"), "ts", _at("$.message.model").alias("model"), _at("$.message.stop_reason").alias("stop_reason"), _number("$.message.usage.input_tokens").alias("input_tokens"), _number("$.message.usage.cache_read_input_tokens").alias("cached_tokens"), _number("$.message.usage.cache_creation_input_tokens").alias("cache_write_tokens"), _number("$.message.usage.output_tokens").alias("output_tokens"), "path", "byte_offset").filter("response_id IS NOT NULL")
    uses = spoken.filter("b.type = 'tool_use'").select("agent", "session_uid", F.col("b.id").alias("call_uid"), F.col("b.name").alias("tool_name"), F.col("b.input").alias("args"), "ts", "path", "byte_offset")
    results = spoken.filter("b.type = 'tool_result'").select(F.col("b.tool_use_id").alias("call_uid"), F.col("ts").alias("result_ts"), F.coalesce("b.is_error", F.lit(False)).alias("is_error"), F.col("b.content").alias("output"), "byte_offset")
    return {"sessions": _sessions(rows), "messages": messages, "calls": _calls(calls), "tool_calls": _tools(uses, results)}


def codex(lines: DataFrame) -> dict[str, DataFrame]:
    rows = lines.select("path", "byte_offset", F.lit("codex").alias("agent"), _at("$.type").alias("type"), _at("$.payload.type").alias("kind"), _time().alias("ts"), _at("$.payload.cwd").alias("cwd"), _at("$.payload.git.branch").alias("git_branch"), "raw")
    # a file is one session: its meta record gives the id, else the uuid at the end of the file's name does
    metas = rows.filter("type = 'session_meta'").groupBy("path").agg(F.min_by(F.struct(_at("$.payload.id").alias("id"), _at("$.payload.forked_from_id").alias("parent_uid")), "byte_offset").alias("m"))
    named = F.nullif(F.regexp_extract("path", r"([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})\.jsonl$", 1), F.lit(""))
    rows = rows.join(metas, "path", "left").withColumn("session_uid", F.coalesce("m.id", named, "path")).withColumn("parent_uid", F.col("m.parent_uid")).drop("m")
    texts = F.array_join(F.transform(F.from_json(_at("$.payload.content"), "array<struct<type:string,text:string>>"), lambda x: F.coalesce(x["text"], F.lit(""))), "\n")
    items = rows.filter("type = 'response_item'")
    messages = items.filter("kind IN ('message', 'reasoning')").select(
        "agent", "session_uid", F.concat_ws("#", "path", "byte_offset").alias("event_uid"), "ts", _at("$.payload.role").alias("role"),
        F.when(F.col("kind") == "reasoning", "thinking").when(_at("$.payload.role") == "user", "human_prompt").when(_at("$.payload.role") == "assistant", "assistant_text").otherwise("injected").alias("message_class"), texts.alias("text"), "path", "byte_offset",
    )
    usage = rows.filter("type = 'token_usage_record'")
    count = lambda k: _number(f"$.payload.usage.{k}")
    turn = rows.filter("type = 'turn_context'").groupBy("path").agg(F.max_by(_at("$.payload.model"), "byte_offset").alias("model"))
    calls = usage.join(turn, "path", "left").select("agent", "session_uid", _at("$.payload.response_id").alias("response_id"), "ts", "model", F.lit(None).cast("string").alias("stop_reason"), (count("input_tokens") - F.coalesce(count("cached_input_tokens"), F.lit(0))).alias("input_tokens"), count("cached_input_tokens").alias("cached_tokens"), count("cache_write_input_tokens").alias("cache_write_tokens"), count("output_tokens").alias("output_tokens"), "path", "byte_offset").filter("response_id IS NOT NULL")
    uses = items.filter("kind IN ('function_call', 'custom_tool_call')").select("agent", "session_uid", _at("$.payload.call_id").alias("call_uid"), _at("$.payload.name").alias("tool_name"), F.coalesce(_at("$.payload.arguments"), _at("$.payload.input")).alias("args"), "ts", "path", "byte_offset")
    output = _at("$.payload.output")
    exit_code = F.expr("try_cast(nullif(regexp_extract(get_json_object(raw, '$.payload.output'), '(?:Process exited with code |\"?exit_code\"?\\\\s*:\\\\s*)(-?[0-9]+)', 1), '') AS INT)")
    results = items.filter("kind IN ('function_call_output', 'custom_tool_call_output')").select(_at("$.payload.call_id").alias("call_uid"), F.col("ts").alias("result_ts"), F.coalesce(exit_code != 0, F.lit(False)).alias("is_error"), output.alias("output"), "byte_offset")
    return {"sessions": _sessions(rows), "messages": messages, "calls": _calls(calls), "tool_calls": _tools(uses, results)}


def pi(lines: DataFrame) -> dict[str, DataFrame]:
    rows = lines.select("path", "byte_offset", F.lit("pi").alias("agent"), _at("$.type").alias("type"), _at("$.id").alias("event_uid"), _time().alias("ts"), _at("$.cwd").alias("cwd"), F.lit(None).cast("string").alias("git_branch"), "raw")
    heads = rows.filter("type = 'session'").groupBy("path").agg(F.min_by(F.struct(F.col("event_uid").alias("id"), _at("$.parentSession").alias("parent_uid")), "byte_offset").alias("m"))
    rows = rows.join(heads, "path", "left").withColumn("session_uid", F.coalesce("m.id", "path")).withColumn("parent_uid", F.col("m.parent_uid")).drop("m")
    spoken = rows.filter("type = 'message'").withColumn("role", _at("$.message.role"))
    blocks = spoken.select("*", F.posexplode(F.from_json(_at("$.message.content"), BLOCK)).alias("block_no", "b"))
    messages = blocks.filter("role <> 'toolResult' AND b.type IN ('text', 'thinking')").select(
        "agent", "session_uid", F.concat_ws("#", "event_uid", "block_no").alias("event_uid"), "ts", "role",
        F.when(F.col("role") == "user", "human_prompt").when(F.col("b.type") == "thinking", "thinking").when(F.col("role") == "assistant", "assistant_text").otherwise("injected").alias("message_class"), F.coalesce("b.text", "b.thinking").alias("text"), "path", "byte_offset",
    )
    calls = spoken.filter("role = 'assistant'").select("agent", "session_uid", F.coalesce(_at("$.message.responseId"), "event_uid").alias("response_id"), "ts", _at("$.message.model").alias("model"), _at("$.message.stopReason").alias("stop_reason"), _number("$.message.usage.input").alias("input_tokens"), _number("$.message.usage.cacheRead").alias("cached_tokens"), _number("$.message.usage.cacheWrite").alias("cache_write_tokens"), _number("$.message.usage.output").alias("output_tokens"), "path", "byte_offset")
    uses = blocks.filter("b.type = 'toolCall'").select("agent", "session_uid", F.col("b.id").alias("call_uid"), F.col("b.name").alias("tool_name"), F.col("b.arguments").alias("args"), "ts", "path", "byte_offset")
    results = spoken.filter("role = 'toolResult'").select(_at("$.message.toolCallId").alias("call_uid"), F.col("ts").alias("result_ts"), F.coalesce(_at("$.message.isError") == "true", F.lit(False)).alias("is_error"), _at("$.message.content").alias("output"), "byte_offset")
    return {"sessions": _sessions(rows), "messages": messages, "calls": _calls(calls), "tool_calls": _tools(uses, results)}


PARSERS = {"claude": claude, "codex": codex, "pi": pi}


def catalogue(lines: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables of several harnesses' lines (by harness) in one."""
    parsed = [PARSERS[agent](own) for agent, own in lines.items()]
    out = parsed[0]
    for other in parsed[1:]:
        out = {name: out[name].unionByName(other[name]) for name in out}
    return out
