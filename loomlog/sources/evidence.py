"""What the logs tell beside messages and calls: replayed records, cumulative usage, turns, spawns, notifications, git evidence.

All are expressions on lines (path, byte_offset, raw) or on the tables of loomlog.sources.transcripts; a file's records are in
the order of their bytes, and windows run over one file or one session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlog.functions import commands

#: Seconds between two records that end the burst in which a fork copies its parent's records.
BURST_GAP = 1.0
# The tools that start a subagent, and the fields of a notification's text.
SPAWN_TOOLS = ("Task", "Agent", "spawn_agent", "subagent")
NOTE_FIELDS = ("task-id", "tool-use-id", "status", "subagent_tokens", "tool_uses", "duration_ms")


def _at(path: str) -> Column:
    return F.get_json_object("raw", path)


def _time() -> Column:
    return F.try_to_timestamp(_at("$.timestamp"))


def without_replay(lines: DataFrame) -> DataFrame:
    """codex lines without what a fork has copied from its parent.

    A file whose first record is a session_meta with forked_from_id is a fork. If that record says where the child's history
    starts, records of a smaller ordinal go. Else the copy is the burst up to the first gap of more than BURST_GAP seconds: before
    the burst's last task_started all goes, after it all but its turn_context. The first record always stays. In any file, an
    item_completed or token_usage_record of another thread goes.
    """
    order = Window.partitionBy("path").orderBy("byte_offset")
    whole = Window.partitionBy("path")
    kind, event = _at("$.type"), _at("$.payload.type")
    head = F.struct(_at("$.payload.id").alias("id"), (kind == "session_meta").alias("meta"), _at("$.payload.forked_from_id").alias("parent"), _at("$.payload.subagent_history_start_ordinal").try_cast("long").alias("start"))
    gap = F.unix_micros(_time()) - F.unix_micros(F.lag(_time()).over(order)) > int(BURST_GAP * 1_000_000)
    seen = lines.withColumns({"_first": F.first(head).over(order), "_n": F.row_number().over(order), "_late": F.max(F.coalesce(gap, F.lit(False)).cast("int")).over(order) == 1})
    own = F.max(F.when(~F.col("_late") & (event == "task_started"), F.col("byte_offset"))).over(whole)
    seen = seen.withColumn("_own", own)
    fork = F.col("_first.meta") & F.col("_first.parent").isNotNull()
    numbered = fork & F.col("_first.start").isNotNull() & (_at("$.ordinal").try_cast("long") < F.col("_first.start"))
    before = F.col("_own").isNull() | (F.col("byte_offset") < F.col("_own"))
    after = (F.col("byte_offset") > F.col("_own")) & ~F.coalesce(kind == "turn_context", F.lit(False))
    burst = fork & F.col("_first.start").isNull() & ~F.col("_late") & (before | after)
    foreign = F.coalesce(event.isin("item_completed") | (kind == "token_usage_record"), F.lit(False)) & F.coalesce(_at("$.payload.thread_id") != F.col("_first.id"), F.lit(False))
    gone = (F.col("_n") > 1) & (F.coalesce(numbered, F.lit(False)) | F.coalesce(burst, F.lit(False)))
    return seen.filter(~gone & ~foreign).select(*lines.columns)


def changed_usage(lines: DataFrame) -> DataFrame:
    """codex token counts (path, byte_offset, ts, input_tokens, cached_tokens, output_tokens) whose total differs from the sample
    before it in the file: a repeated total is no new call, one that falls is. Give all lines, replayed ones too, so that a fork's
    inherited total is what its first own sample is compared with, and keep the own ones afterwards."""
    samples = lines.filter((_at("$.payload.type") == "token_count") & _at("$.payload.info.total_token_usage").isNotNull())
    total = _at("$.payload.info.total_token_usage")
    before = F.lag(total).over(Window.partitionBy("path").orderBy("byte_offset"))
    last = lambda name: _at(f"$.payload.info.last_token_usage.{name}").try_cast("long")
    own = samples.withColumn("_new", F.coalesce(total != before, F.lit(True))).filter("_new")
    return own.select("path", "byte_offset", _time().alias("ts"), (last("input_tokens") - F.coalesce(last("cached_input_tokens"), F.lit(0))).alias("input_tokens"), last("cached_input_tokens").alias("cached_tokens"), last("output_tokens").alias("output_tokens"))


def turns(messages: DataFrame, calls: DataFrame, tool_calls: DataFrame) -> DataFrame:
    """One row per turn: agent, session_uid, turn_no (0: before the first prompt), prompt_uid, started_at, ended_at, calls, tool_calls.

    A turn begins with a prompt and lasts to the next one of its session, in the order of the log.
    """
    key, place = ["agent", "session_uid"], ["path", "byte_offset"]
    said = messages.select(*key, *place, "ts", F.when(F.col("message_class") == "human_prompt", F.col("event_uid")).alias("prompt"), F.lit("message").alias("kind"))
    none = F.lit(None).cast("string").alias("prompt")
    events = said.unionByName(calls.select(*key, *place, "ts", none, F.lit("call").alias("kind"))).unionByName(tool_calls.select(*key, *place, "ts", none, F.lit("tool").alias("kind")))
    rank = F.when(F.col("kind") == "message", 0).when(F.col("kind") == "call", 1).otherwise(2)  # a line may hold all three
    number = F.count("prompt").over(Window.partitionBy(*key).orderBy(*place, rank).rowsBetween(Window.unboundedPreceding, 0))
    of = lambda kind: F.count_if(F.col("kind") == kind)
    return events.withColumn("turn_no", number).groupBy(*key, "turn_no").agg(F.min("prompt").alias("prompt_uid"), F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), of("call").alias("calls"), of("tool").alias("tool_calls"))


def spawns(tool_calls: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """Calls that start a subagent: spawn_uid, agent, session_uid, spawned_at, requested_type (general-purpose if a claude call names
    none), description, background, child_agent_id (from claude lines: the result that names it), completion."""
    arg = lambda *names: F.coalesce(*[F.get_json_object("args", f"$.{n}") for n in names])
    made = tool_calls.filter(F.col("tool_name").isin(*SPAWN_TOOLS))
    made = made.filter((F.col("tool_name") != "subagent") | arg("workflowScript").isNotNull() | arg("action").isin("run", "start", "spawn") | arg("tasks").isNotNull())
    kind = F.coalesce(arg("subagent_type", "agent_type", "agent"), F.when(F.col("agent") == "claude", "general-purpose"))
    out = made.select(F.col("call_uid").alias("spawn_uid"), "agent", "session_uid", F.col("ts").alias("spawned_at"), kind.alias("requested_type"), arg("description", "task_name", "name").alias("description"), F.coalesce(arg("run_in_background") == "true", F.lit(False)).alias("background"), F.when(F.col("result_ts").isNotNull(), F.when(F.col("is_error"), "error").otherwise("returned")).alias("completion"))
    if lines is None:
        return out.withColumn("child_agent_id", F.lit(None).cast("string"))
    result = F.coalesce(_at("$.toolUseResult.agentId"), _at("$.toolUseResult.agent_id"))
    told = lines.filter(result.isNotNull()).select(F.explode(F.from_json(_at("$.message.content"), "array<struct<tool_use_id:string>>")).alias("b"), result.alias("child_agent_id"))
    named = told.groupBy(F.col("b.tool_use_id").alias("spawn_uid")).agg(F.min("child_agent_id").alias("child_agent_id"), F.max("child_agent_id").alias("_last")).filter("child_agent_id = _last").drop("_last")
    return out.join(named, "spawn_uid", "left")


def notifications(messages: DataFrame) -> DataFrame:
    """Notices that a task has ended, in a session's messages: task_id, call_uid, status, tokens, tool_uses, duration_ms. The same
    notice twice is one."""
    text = F.col("text")
    field = lambda name: F.nullif(F.trim(F.regexp_extract(text, rf"<{name}>\s*([^<]{{0,200}}?)\s*</{name}>", 1)), F.lit(""))
    names = ("task_id", "call_uid", "status", "tokens", "tool_uses", "duration_ms")
    found = messages.filter(F.ltrim(text).startswith("<task-notification>"))
    parts = found.select("agent", "session_uid", "ts", F.sha2(text, 256).alias("notice"), *[field(tag).alias(name) for tag, name in zip(NOTE_FIELDS, names, strict=True)])
    numbers = {c: F.col(c).try_cast("long") for c in ("tokens", "tool_uses", "duration_ms")}
    return parts.withColumns(numbers).groupBy("agent", "session_uid", "notice", *names).agg(F.min("ts").alias("ts")).drop("notice")


def git_evidence(tool_calls: DataFrame) -> DataFrame:
    """What shell calls did to git: event_uid, agent, session_uid, ts, op, sha_short. A commit counts if its output names a hash, a
    push if the call didn't fail; the key is the call, the operation and the hash, so that a record seen twice gives one event."""
    command = F.coalesce(F.get_json_object("args", "$.command"), F.get_json_object("args", "$.cmd"), F.get_json_object("args", "$.script"))
    used = tool_calls.filter(command.contains("git")).withColumn("_ops", F.array_distinct(commands.git_operations(command)))
    shas = F.regexp_extract_all(F.coalesce("output", F.lit("")), F.lit(r"(?m)^\[[^\]\n]*?([0-9a-f]{7,40})\]"), F.lit(1))
    made = F.when(F.arrays_overlap("_ops", F.array(F.lit("commit"), F.lit("cherry-pick"))), F.transform(shas, lambda s: F.struct(F.lit("commit").alias("op"), s.alias("sha_short")))).otherwise(F.array().cast("array<struct<op:string,sha_short:string>>"))
    pushed = F.when(F.array_contains("_ops", "push") & ~F.coalesce("is_error", F.lit(False)), F.array(F.struct(F.lit("push").alias("op"), F.lit(None).cast("string").alias("sha_short")))).otherwise(F.array().cast("array<struct<op:string,sha_short:string>>"))
    rows = used.select("agent", "session_uid", "call_uid", F.coalesce("result_ts", "ts").alias("ts"), F.explode(F.concat(made, pushed)).alias("e"))
    uid = F.concat_ws(":", "call_uid", "e.op", F.left("e.sha_short", F.lit(7)))
    return rows.select(uid.alias("event_uid"), "agent", "session_uid", "ts", "e.op", "e.sha_short").dropDuplicates(["event_uid"])


def session_state(lines: DataFrame) -> DataFrame:
    """The latest title and permission mode of each claude session: a title of the owner's before one that was made up."""
    own, made, mode = (F.when(_at("$.type") == kind, _at(f"$.{name}")) for kind, name in (("custom-title", "customTitle"), ("ai-title", "aiTitle"), ("permission-mode", "permissionMode")))
    place = F.struct("path", "byte_offset")
    last = lambda value: F.max_by(value, F.when(value.isNotNull(), place))
    return lines.filter(_at("$.sessionId").isNotNull()).groupBy(_at("$.sessionId").alias("session_uid")).agg(F.coalesce(last(own), last(made)).alias("title"), last(mode).alias("permission_mode"))


#: Bytes of a whole-file JSON beside a log that are read; a larger one is an issue.
SIDECAR_BYTES = 1 << 20


def sidecars(spark: SparkSession, root: str, schema: str, pattern: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """Whole JSON files beside the logs as (path, value), and an issue row (path, issue) for each that is too large or no object."""
    found = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root)
    large = F.col("_metadata.file_size") > SIDECAR_BYTES
    kind = F.when(large, "too_large").when(F.try_parse_json("value").isNull(), "json_error").when(~F.ltrim("value").startswith("{"), "not_object")
    rows = found.select(F.col("_metadata.file_path").alias("path"), kind.alias("issue"), F.when(~large, F.col("value")).alias("value"))
    return rows.filter("issue IS NULL").select("path", F.from_json("value", schema).alias("value")), rows.filter("issue IS NOT NULL").select("path", "issue")


def permissions(lines: DataFrame) -> DataFrame:
    """A permission log's lines as ts, tool_name, cmd_verb, reason: what loomlog.plans.provenance.denials joins to the transcripts'."""
    first = lambda *names: F.coalesce(*[_at(f"$.{n}") for n in names])
    command = first("tool_input.command", "command")
    return lines.filter(first("tool_name", "tool").isNotNull()).select(F.try_to_timestamp(first("timestamp", "ts")).alias("ts"), first("tool_name", "tool").alias("tool_name"), commands.program(command).alias("cmd_verb"), first("reason", "permission_decision_reason").alias("reason"))
