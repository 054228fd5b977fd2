"""What happens in a thread, record by record: events of three harnesses' logs as column expressions, for loomlog.streaming.collector.

A record gives any number of events (tick, model, start, end, human, call, tool, result, ...), numbered in their order. All that can be
told from the record alone is told here: a call's class and what it waits for, the rules under which a result counts as something that
happened, exit codes, failures. What depends on earlier records is left to the fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.functions import classify, commands

#: flag: worker (meta), interrupted (end), failed (result), of a user's turn (user). events: rules by which a result is an event.
#: marks: letters that a result's text earns (c complete, r rate limited, x cancelled, s still running, n nothing spawned, p patch failed).
FIELDS = (
    "kind string, flag boolean, uid string, parent string, model string, error string, text string, id string, cls string, target string, rule string, wait_tool string, wait_ms double, delivery array<string>, background boolean, "
    "route array<string>, spawns int, total long, hit long, output long, events array<string>, exit int, running string, findings array<string>, marks string"
)
EVENT = f"agent string, thread string, byte_offset long, n int, at long, {FIELDS}"

# Commands by what they wait for, in order of precedence.
POLL_TARGETS = (
    ("ci", r"gh run (watch|view)|gh pr checks|check-runs|actions/runs"),
    ("coderabbit", r"coderabbit"),
    ("review_harness", r"xreview|claude -p|claude --print|codex exec"),
    ("sleep", r"^\s*sleep|;\s*sleep|until |while "),
    ("gate", r"\bjust\b|make |go test|pytest|npm|pnpm|cargo|tofu|terraform|kubectl|helm|docker"),
)
# What failed spawns say, in order of precedence.
SPAWN_ERRORS = (
    ("thread_limit", r"(?i)thread limit"),
    ("unknown_model", r"(?i)unknown model"),
    ("path_exists", r"(?is)agent path .{0,512} already exists"),
    ("fork_type", r"(?i)forked agents inherit|full-history fork"),
    ("parse", r"(?i)failed to parse function arguments"),
)
# Tools by class, the reasons of failed turns, and how injected text begins.
CODEX_TOOLS = {"wait": "wait", "wait_agent": "wait", "sleep": "wait", "list_agents": "status", "get_goal": "status", "spawn_agent": "orchestrate", "send_message": "orchestrate", "followup_task": "orchestrate", "interrupt_agent": "orchestrate", "request_user_input": "human", "request_user_input_async": "human"}
CODEX_SHELLS = ("exec", "exec_command", "js", "run", "shell", "write_stdin")
CLAUDE_TOOLS = {
    "TaskOutput": "wait", "BashOutput": "wait", "Monitor": "wait", "ScheduleWakeup": "wait", "Sleep": "wait", "TaskList": "status", "TaskGet": "status", "ListAgents": "status",
    "Agent": "orchestrate", "Task": "orchestrate", "SendMessage": "orchestrate", "TaskStop": "orchestrate", "KillShell": "orchestrate", "Workflow": "orchestrate", "TeamCreate": "orchestrate", "AskUserQuestion": "human",
}
CLAUDE_ERRORS = {"rate_limit": "usage_limit", "server_error": "upstream", "overloaded": "upstream", "api_error": "upstream"}
UPSTREAM = ("server_overloaded", "internal_server_error", "http_connection_failed", "response_stream_disconnected", "response_stream_connection_failed", "response_too_many_failed_attempts")
NOT_HUMAN = ("<task-notification>", "<local-command-stdout>", "<local-command-stderr>", "<local-command-caveat>", "<bash-stdout>", "<bash-stderr>", "<system-reminder>", "[Request interrupted")
INJECTED = ("# AGENTS.md instructions", "Another language model started to solve this problem")
EFFORTS = ("low", "medium", "high", "xhigh", "max")
EXITED = r'(?:Process exited with code |"?exit_code"?\s*:\s*)(-?[0-9]+)'
SAFE = r"^[A-Za-z0-9][A-Za-z0-9._:/\[\]+-]{0,63}$"

_TYPES = dict(f.strip().split(" ", 1) for f in FIELDS.split(", "))


def _event(when: Column | None, kind: str, **fields: Column) -> Column:
    """A FIELDS struct where the condition holds, else null."""
    values = {"kind": F.lit(kind)} | fields
    row = F.struct(*[values.get(n, F.lit(None)).cast(t).alias(n) for n, t in _TYPES.items()])
    return row if when is None else F.when(when, row)


def _mapped(value: Column, table: dict[str, str]) -> Column:
    out = F
    for name, word in table.items():
        out = out.when(value == name, word)
    return out


def poll_target(command: Column) -> Column:
    out = F
    for name, pattern in POLL_TARGETS:
        out = out.when(F.lower(command).rlike(pattern), name)
    return out.otherwise("other")


def delivery(command: Column) -> Column:
    """What a command delivers: push, gate, ci, cr (a review), in this order."""
    parts = commands.simple_commands(command)
    has = lambda pattern: F.exists(parts, lambda p: p.rlike(pattern))
    kinds = F.array(
        F.when(F.array_contains(commands.git_operations(command), "push"), "push"), F.when(has(r"^(just|make)\s+(?:\S+\s+)*?(check|test|ci)(\s|$)"), "gate"),
        F.when(has(r"^gh\s+run\s+watch(\s|$)|^gh\s+pr\s+checks\s.*--watch"), "ci"), F.when(has(r"^(coderabbit|cr)\s.*--agent(\s|$)"), "cr"),
    )
    return F.when(command.isNotNull(), F.array_compact(kinds))


def protocol(text: Column) -> Column:
    """The loop protocol that a thread's first prompt declares."""
    version = F.regexp_extract(text, r"Contract:\s*`?loop-v([0-9]+(?:\.[0-9]+)*)", 1)
    return F.when(version == "2.1", "v2.1").when(version.isin("2", "2.0"), "v2.0").when(version == "3", "v3").when(version != "", "other").otherwise("none")


def _review(text: Column) -> dict[str, Column]:
    found = F.regexp_extract_all(text, F.lit(r'"severity"\s*:\s*"(critical|major|minor|trivial|info)"'), F.lit(1))
    marks = F.concat(F.when(text.rlike(r'"type"\s*:\s*"complete"'), "c").otherwise(""), F.when(text.rlike("(?i)rate[ _-]?limit"), "r").otherwise(""), F.when(F.lower(text).contains("cancelled"), "x").otherwise(""))
    return {"findings": found, "marks": marks}


def _with(value: Column, body) -> Column:
    """body of the value, computed once."""
    return F.transform(F.array(value), body)[0]


def _flat(*events: Column) -> Column:
    """Events (structs or arrays of them) in order, without those that don't hold."""
    return F.array_compact(F.flatten(F.array_compact(F.array(*events))))


def _one(event: Column) -> Column:
    return F.array(event)


def _rows(lines: DataFrame, agent: str, events: Column) -> DataFrame:
    # Z and offsets alike; a record without a time counts at the last one of its thread
    at = F.unix_micros(F.try_to_timestamp(F.get_json_object("raw", "$.timestamp")))
    told = lines.select(F.lit(agent).alias("agent"), F.col("path").alias("thread"), "byte_offset", at.alias("at"), F.posexplode(events).alias("n", "e"))
    return told.select("agent", "thread", "byte_offset", "n", "at", "e.*")


def codex(lines: DataFrame) -> DataFrame:
    j = lambda path: F.get_json_object("raw", f"$.{path}")
    p = lambda path: j(f"payload.{path}")
    is_, sub = lambda a, b: (j("type") == a) & (p("type") == b), p("source.subagent")
    error = F.lower(F.coalesce(p("error.message"), p("error"), F.lit("")))
    info = F.coalesce(p("error.codex_error_info"), F.lit(""))
    reason = (
        F.when((info == "usage_limit_exceeded") | error.contains("usage limit"), "usage_limit").when(info.startswith("cyber_policy") | info.contains('"cyber_policy"') | error.contains("flagged"), "flagged")
        .when(info.rlike("|".join(UPSTREAM)) | error.rlike(r'^(unexpected status|stream disconnected|stream error|\{"type":"error")'), "upstream").otherwise("other")
    )
    items = F.from_json(p("content"), "array<struct<type:string,text:string>>")
    typed = lambda t: F.regexp_extract(F.ltrim(t), r"^<([A-Za-z_][\w-]*)", 1)
    own = lambda x: (x["type"] == "input_image") | ((x["type"] == "input_text") & (F.trim(x["text"]) != "") & (typed(x["text"]).isin("image", "send_user_message_question_reply") | ((typed(x["text"]) == "") & ~F.ltrim(x["text"]).rlike("^(?:" + "|".join(INJECTED) + ")"))))
    said = F.array_join(F.transform(items, lambda x: F.coalesce(x["text"], F.lit(""))), "\n")

    name, args = p("name"), F.coalesce(p("arguments"), p("input"), F.lit(""))
    field = lambda key: F.get_json_object(args, f"$.{key}")
    number = lambda text, pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).cast("double")
    shell = name.isin(*CODEX_SHELLS)
    given = F.regexp_extract_all(args, F.lit(r'"?cmd"?\s*:\s*"((?:[^"\\]|\\.)*)"'), F.lit(1))
    argv = F.get(F.from_json(field("command"), "array<string>"), F.size(F.from_json(field("command"), "array<string>")) - 1)
    unescaped = F.transform(given, lambda c: F.replace(F.replace(F.replace(c, F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\")))
    run = F.when(F.size(given) > 0, F.array_join(unescaped, "\n")).otherwise(F.coalesce(argv, field("cmd"), field("command")))
    polled = args.rlike(r'write_stdin\(\s*\{[^}]*"?chars"?\s*:\s*""') | ((name == "write_stdin") & (field("chars") == ""))
    process = F.coalesce(F.nullif(F.regexp_extract(args, r'"?session_id"?\s*:\s*"?(\d+)', 1), F.lit("")), F.lit("?"))
    cls = F.coalesce(_mapped(name, CODEX_TOOLS), F.when(shell, F.when(polled, "wait").otherwise(classify.command_class(args))), F.lit("work"))
    kind = F.when(shell & polled, "poll").when(name == "wait_agent", "agent").when(name == "sleep", "sleep").when(name == "wait", "cell").when(args.contains("wait_agent"), "agent").when(args.contains("tools.wait("), "cell").when(args.rlike("tools[.]sleep|setTimeout"), "sleep")
    target = F.when(kind == "poll", F.concat(F.lit("@"), process)).otherwise(F.coalesce(kind, poll_target(F.array_join(given, " ; "))))
    wait_ms = F.coalesce(
        F.when(name == "wait_agent", field("timeout_ms").cast("double")).when(name == "sleep", field("duration_ms").cast("double")).when(name == "wait", F.coalesce(field("yield_time_ms"), field("timeout_ms")).cast("double")),
        F.when(kind == "poll", number(args, r'"?yield_time_ms"?\s*:\s*(\d+)')).when(kind == "agent", number(args, r'wait_agent\(\s*\{[^}]*?"?timeout_ms"?\s*:\s*(\d+)')).when(kind == "cell", number(args, r'tools\.wait\(\s*\{[^}]*?"?(?:yield_time_ms|timeout_ms)"?\s*:\s*(\d+)')).when(kind == "sleep", number(args, r'tools\.sleep\(\s*\{[^}]*?"?duration_ms"?\s*:\s*(\d+)')),
    )
    word = lambda value, absent: F.when(F.coalesce(value, F.lit("")) == "", absent).when(value.rlike(SAFE), value).otherwise("other")
    effort, fork = F.coalesce(field("reasoning_effort"), F.lit("")), F.coalesce(field("fork_turns"), F.lit(""))
    route = F.array(word(field("model"), "inherit"), F.when(effort == "", "inherit").when(effort.isin(*EFFORTS), effort).otherwise("other"), word(field("agent_type"), "default"), F.when(fork.isin("", "none"), "none").when(fork == "all", "all").otherwise("other"))
    sites = F.when(shell, F.size(F.regexp_extract_all(args, F.lit(r"tools\.(?:collaboration__)?spawn_agent\("), F.lit(0))))
    tool = _event(
        None, "tool", id=F.coalesce(p("call_id"), p("id")), cls=cls, target=target, rule=F.when(name == "apply_patch", "patch").when((kind == "agent") | (name == "wait_agent"), "agent").when(target == "sleep", "sleep").otherwise("exec"),
        wait_tool=F.when(kind == "poll", "write_stdin").when(kind == "agent", "wait_agent").when(kind == "cell", "cell_wait").when(kind == "sleep", "sleep"), wait_ms=wait_ms, delivery=F.when(shell, delivery(run)), route=F.when(name == "spawn_agent", route),
        spawns=F.when(name == "spawn_agent", -1).when(sites > 0, sites), text=F.when(shell & ~polled & (F.size(given) > 0), poll_target(given[0])),
    )
    out = F.coalesce(F.when(F.ltrim(p("output")).startswith("["), F.array_join(F.transform(F.from_json(p("output"), "array<struct<text:string>>"), lambda x: F.coalesce(x["text"], F.lit(""))), " ")), p("output"), F.lit(""))
    last_exit = lambda t: F.try_element_at(F.regexp_extract_all(t, F.lit(EXITED), F.lit(1)), F.lit(-1)).cast("int")
    spawn_error = F.when(F.coalesce(*[F.get_json_object(out, f"$.{k}") for k in ("task_name", "agent_id", "thread_id", "nickname")]).isNotNull() | out.rlike(r'"(?:task_name|agent_id)"\s*:'), F.lit(None))
    for kind_, pattern in SPAWN_ERRORS:
        spawn_error = spawn_error.when(out.rlike(pattern), kind_)
    review = _review(out)
    marks = F.concat(review["marks"], F.when(out.startswith("Script running"), "s").otherwise(""), F.when(out.contains("spawn_agent is not a function"), "n").otherwise(""), F.when(out.rlike(r"(?i)^\s*(apply_patch verification failed|failed to apply|error)"), "p").otherwise(""))
    result = _event(
        None, "result", id=p("call_id"), events=F.array_compact(F.array(F.when(out.rlike(r'"?timed_out"?\s*:\s*false'), "agent"), F.when(out.rlike(EXITED), "exec"))), exit=last_exit(out), running=F.nullif(F.regexp_extract(out, r'(?:"?session_id"?:\s*|session ID )(\d+)', 1), F.lit("")),
        flag=out.startswith("Script failed") | F.coalesce(F.exists(F.regexp_extract_all(out, F.lit(EXITED), F.lit(1)), lambda x: x.cast("int") != 0), F.lit(False)), error=spawn_error.otherwise("other"), findings=review["findings"], marks=marks,
    )
    item = (j("type") == "response_item")  # noqa: UP034
    usage = lambda where: {"total": F.coalesce(p(f"{where}.input_tokens").cast("long"), F.lit(0)), "hit": F.coalesce(p(f"{where}.cached_input_tokens").cast("long"), F.lit(0)), "output": F.coalesce(p(f"{where}.output_tokens").cast("long"), F.lit(0))}
    events = _flat(
        _one(_event(j("type") == "session_meta", "meta", flag=sub.isNotNull() | F.coalesce(p("thread_source") == "subagent", F.lit(False)), uid=F.coalesce(p("id"), p("session_id")), parent=F.coalesce(p("source.subagent.thread_spawn.parent_thread_id"), p("parent_thread_id")))),
        _one(_event(None, "tick")),
        _one(_event(F.coalesce(F.when(j("type") == "turn_context", p("model")), F.when(is_("event_msg", "thread_settings_applied"), p("thread_settings.model")), F.lit("")) != "", "model", model=F.coalesce(F.when(j("type") == "turn_context", p("model")), p("thread_settings.model")))),
        _one(_event(j("type") == "compacted", "compact")), _one(_event(is_("event_msg", "task_started"), "start")),
        _one(_event(is_("event_msg", "turn_aborted"), "end", error=F.lit("aborted"), flag=F.coalesce(p("reason") == "interrupted", F.lit(False)))),
        _one(_event(is_("event_msg", "task_complete"), "end", error=F.when(p("error").isNotNull(), reason))),
        _one(_event(is_("event_msg", "user_message"), "human", text=protocol(F.coalesce(p("message"), F.lit(""))), rule=F.lit("event"))),
        _one(_event(item & (p("type") == "message") & (p("role") == "user") & F.coalesce(F.exists(items, own), F.lit(False)), "human", text=protocol(said), rule=F.lit("item"))),
        F.when(item & p("type").isin("function_call", "custom_tool_call"), _one(tool)), F.when(item & p("type").isin("function_call_output", "custom_tool_call_output"), _one(result)),
        _one(_event(item & (p("type") == "agent_message"), "trigger", text=F.lit("agent_msg"))),
        _one(_event(j("type") == "token_usage_record", "usage", flag=p("usage").isNotNull(), **usage("usage"))),
        _one(_event(is_("event_msg", "token_count") & p("info.total_token_usage.total_tokens").isNotNull(), "count", uid=p("info.total_token_usage.total_tokens"), flag=p("info.last_token_usage").isNotNull(), **usage("info.last_token_usage"))),
    )
    return _rows(lines, "codex", events)


BLOCKS = "array<struct<type:string,text:string,id:string,name:string,input:string,arguments:string,tool_use_id:string,content:string,is_error:boolean>>"


def _texts(json: Column) -> Column:
    """The text of a content field: a string as it is, the text blocks of an array by lines."""
    parts = F.filter(F.transform(F.from_json(json, "array<struct<text:string>>"), lambda x: x["text"]), lambda t: t.isNotNull())
    return F.when(F.ltrim(json).startswith("["), F.array_join(parts, "\n")).otherwise(F.coalesce(json, F.lit("")))


def _shell(command: Column) -> dict[str, Column]:
    cls = classify.command_class(F.concat(F.lit("tools."), command))
    return {"cls": cls, "target": F.when(cls == "wait", poll_target(command)).otherwise("other"), "delivery": delivery(command)}


def claude(lines: DataFrame) -> DataFrame:
    j = lambda path: F.get_json_object("raw", f"$.{path}")
    kind, content, result = j("type"), j("message.content"), j("toolUseResult")
    blocks = F.when(F.ltrim(content).startswith("["), F.from_json(content, BLOCKS))
    of = lambda t: F.filter(blocks, lambda b: b["type"] == t)
    arg = lambda b, key: F.get_json_object(b["input"], f"$.{key}")

    def tool(b: Column) -> Column:
        shell = _shell(F.coalesce(arg(b, "command"), F.lit("")))
        background = F.coalesce(arg(b, "run_in_background") == "true", F.lit(False))
        bash, spawn = b["name"] == "Bash", b["name"].isin("Agent", "Task")
        cls = F.coalesce(_mapped(b["name"], CLAUDE_TOOLS), F.when(bash & ~background, shell["cls"]), F.lit("work"))
        target = F.when(b["name"].isin("ScheduleWakeup", "Sleep"), "sleep").when(b["name"] == "TaskOutput", F.concat(F.lit("#"), F.coalesce(arg(b, "task_id"), F.lit("")))).when(bash & (cls == "wait"), shell["target"]).otherwise("other")
        rule = F.when(target == "sleep", "sleep").when(b["name"] == "Monitor", "any").when(b["name"].isin("TaskOutput", "BashOutput"), "task").otherwise("bash")
        typed = F.regexp_replace(F.coalesce(arg(b, "subagent_type"), F.lit("")), "^.*:", "")
        route = F.array(F.when(F.coalesce(arg(b, "model"), F.lit("")) == "", "inherit").when(arg(b, "model").rlike(SAFE), arg(b, "model")).otherwise("other"), F.lit("inherit"), F.when(typed == "", "default").when(typed.rlike(SAFE), typed).otherwise("other"), F.lit("none"))
        return _event(None, "tool", id=b["id"], cls=cls, target=target, rule=rule, delivery=F.when(bash, shell["delivery"]), background=background, route=F.when(spawn, route), spawns=F.when(spawn, -1))

    state = F.coalesce(F.get_json_object(result, "$.task.status"), F.get_json_object(result, "$.status"))
    stopped = F.lit(False)
    for key in ("interrupted", "timedOutAfterMs", "backgroundTaskId"):
        stopped = stopped | classify.truthy(result, f"$.{key}")
    is_object = F.coalesce(F.ltrim(result).startswith("{"), F.lit(False))
    events = F.array_compact(F.array(F.lit("any"), F.when(is_object & ~F.coalesce(state, F.lit("running")).isin("running", "pending"), "task"), F.when(is_object & ~stopped, "bash")))

    def answered(b: Column) -> Column:
        text = _texts(b["content"])
        review = _review(text)
        return _event(None, "result", id=b["tool_use_id"], events=events, flag=F.coalesce(b["is_error"], F.lit(False)), exit=F.when(F.coalesce(b["is_error"], F.lit(False)), 1).otherwise(0), background=classify.truthy(result, "$.backgroundTaskId"), findings=review["findings"], marks=review["marks"])

    text = _texts(content)
    interrupted = F.when(blocks.isNotNull(), F.exists(of("text"), lambda b: b["text"].startswith("[Request interrupted by user"))).otherwise(text.startswith("[Request interrupted by user"))
    none = F.coalesce(F.size(of("tool_result")), F.lit(0)) <= 0
    human = F.coalesce((j("origin.kind") == "human") & ~text.startswith("[Request interrupted"), (F.coalesce(j("isMeta"), F.lit("false")) != "true") & (F.coalesce(j("isCompactSummary"), F.lit("false")) != "true") & (F.trim(text) != "") & ~F.ltrim(text).rlike("^(?:" + "|".join(w.replace("[", r"\[") for w in NOT_HUMAN) + ")"))
    user, assistant, system = kind == "user", kind == "assistant", kind == "system"
    count = lambda key: F.coalesce(j(f"message.usage.{key}").cast("long"), F.lit(0))
    real = F.coalesce(j("message.model"), F.lit("")) != "<synthetic>"
    failed = F.coalesce(j("isApiErrorMessage") == "true", F.lit(False))
    out = _flat(
        _one(_event(j("sessionId").isNotNull(), "meta", flag=F.col("path").contains("/subagents/"), uid=F.coalesce(j("agentId"), j("sessionId")), parent=F.when(F.col("path").contains("/subagents/"), j("sessionId")))),
        _one(_event(system & (j("subtype") == "compact_boundary"), "compact", rule=F.lit("boundary"))), _one(_event(j("isCompactSummary") == "true", "compact", rule=F.lit("summary"))),
        _one(_event(assistant & real & j("message.model").isNotNull(), "model", model=j("message.model"))), _one(_event(user | assistant | (system & (j("subtype") == "turn_duration")), "tick")),
        _one(_event(system & (j("subtype") == "turn_duration"), "end")),
        _one(_event(assistant & (failed | (j("message.stop_reason") == "refusal")), "error", error=F.when(failed, F.coalesce(_mapped(j("error"), CLAUDE_ERRORS), F.lit("other"))).otherwise("flagged"))),
        _one(_event(assistant & real & j("message.id").isNotNull() & (F.coalesce(j("message.usage"), F.lit("{}")) != "{}"), "usage", id=j("message.id"), flag=F.lit(True), total=count("input_tokens") + count("cache_read_input_tokens") + count("cache_creation_input_tokens"), hit=count("cache_read_input_tokens"), output=count("output_tokens"))),
        F.when(assistant, F.transform(of("tool_use"), tool)), _one(_event(assistant & (j("message.stop_reason") == "end_turn"), "rest")),
        _one(_event(user, "user")), F.when(user, F.transform(of("tool_result"), answered)), _one(_event(user & F.get_json_object(result, "$.agentId").isNotNull(), "agent", id=F.get_json_object(result, "$.agentId"))),
        _one(_event(user & F.coalesce(interrupted, F.lit(False)), "error", error=F.lit("aborted"), flag=F.lit(True))),
        _one(_event(user & ~F.coalesce(interrupted, F.lit(False)) & none & human, "human", text=protocol(text))),
        _one(_event(user & none, "asked", text=F.when(blocks.isNull() & text.startswith("<task-notification>"), "event").otherwise("user"), flag=blocks.isNotNull())),
    )
    return _rows(lines, "claude", out)


def pi(lines: DataFrame) -> DataFrame:
    j = lambda path: F.get_json_object("raw", f"$.{path}")
    kind, role, custom = j("type"), j("message.role"), j("customType")
    blocks = F.when(F.ltrim(j("message.content")).startswith("["), F.from_json(j("message.content"), BLOCKS))
    worker = F.col("path").rlike(r"/run-[0-9]+/session\.jsonl$")
    count = lambda key: F.coalesce(j(f"message.usage.{key}").cast("long"), F.lit(0))
    arg = lambda b, key: F.get_json_object(b["arguments"], f"$.{key}")

    def tool(b: Column) -> Column:
        name, action = b["name"], arg(b, "action")
        shell, deadline = _shell(F.coalesce(arg(b, "command"), F.lit(""))), arg(b, "deadline_s").cast("double")
        launches = (name == "subagent") & (arg(b, "workflowScript").isNotNull() | F.coalesce(action.isin("run", "start", "spawn"), F.lit(False)) | classify.truthy(b["arguments"], "$.tasks"))
        cls = F.when(name == "bash", shell["cls"]).when(name == "watch_process", "wait").when((name == "subagent") & action.isin("list", "status"), "status").when((name == "subagent") & (action == "wait"), "wait").when(launches | name.isin("watch_start", "wake_at"), "orchestrate").otherwise("work")
        target = F.when(name == "watch_process", poll_target(F.coalesce(arg(b, "command"), F.lit("")))).when(name == "bash", shell["target"]).when((name == "subagent") & (cls == "wait"), "agent").otherwise("other")
        rule = F.when(name == "watch_process", "process").when(name == "subagent", "agent").when((name == "bash") & (target == "sleep"), "sleep").otherwise("exec")
        asked = F.when((name == "watch_process") & deadline.between(0, 3600), deadline * 1000)
        return _event(None, "tool", id=b["id"], cls=cls, target=target, rule=rule, wait_tool=F.when(asked.isNotNull(), "watch_process"), wait_ms=asked, delivery=F.when(name == "bash", shell["delivery"]), spawns=F.when(launches, -2))

    text = _texts(j("message.content"))
    review, details = _review(text), j("message.details")
    children = F.from_json(F.get_json_object(details, "$.results"), "array<struct<agent:string,sessionFile:string,exitCode:int,index:int>>")
    known = F.filter(children, lambda c: F.coalesce(c["agent"], F.lit("")) != "")
    ran = lambda c: c["sessionFile"].isNotNull() | (F.coalesce(c["exitCode"], F.lit(1)) == 0)
    lost = F.size(F.filter(known, lambda c: ~ran(c) & F.coalesce(c["exitCode"] != 0, F.lit(False))))
    failed = F.coalesce(j("message.isError") == "true", F.lit(False))
    process = (F.get_json_object(details, "$.deadline_hit") == "false") & F.get_json_object(details, "$.exit_code").cast("int").isNotNull()
    result = _event(
        None, "result", id=j("message.toolCallId"), events=F.array_compact(F.array(F.when(process, "process"), F.when(classify.truthy(details, "$.results"), "agent"))), flag=failed, exit=F.when(failed, 1).otherwise(0), findings=review["findings"], marks=review["marks"],
        spawns=F.when(lost > 0, lost).otherwise(0), route=F.transform(F.filter(known, ran), lambda c: F.when(c["agent"].rlike(SAFE), c["agent"]).otherwise("other")), uid=F.coalesce(F.get_json_object(details, "$.runId"), F.get_json_object(details, "$.asyncId")),
    )
    message = kind == "message"
    turn = F.lit("user")
    stop = j("message.stopReason")
    events = _flat(
        _one(_event(kind == "session", "meta", flag=worker, uid=j("id"))), _one(_event(None, "tick")), _one(_event((kind == "model_change") & j("modelId").isNotNull(), "model", model=j("modelId"))), _one(_event(kind == "compaction", "compact")),
        _one(_event((kind == "custom_message") & custom.isin("loop-watch", "loop-wake", "loop-continuation", "subagent-notify", "subagent-incremental-child-notify"), "trigger", text=F.when(custom == "loop-continuation", "orchestrate").when(custom.startswith("loop"), "event").otherwise("agent_msg"), flag=F.lit(True))),
        _one(_event(message & (role == "user"), "human", text=protocol(text), flag=F.lit(True))), _one(_event(message & (role == "user"), "trigger", text=turn, flag=F.lit(True))),
        _one(_event(message & (role == "assistant") & (F.coalesce(j("message.model"), F.lit("")) != ""), "model", model=j("message.model"))),
        _one(_event(message & (role == "assistant") & (F.coalesce(j("message.usage"), F.lit("{}")) != "{}"), "usage", flag=F.lit(True), total=count("input") + count("cacheRead") + count("cacheWrite"), hit=count("cacheRead"), output=count("output"))),
        _one(_event(message & (role == "assistant") & stop.isin("error", "aborted"), "error", error=F.when(stop == "error", "api_error").otherwise("aborted"))),
        F.when(message & (role == "assistant"), F.transform(F.filter(blocks, lambda b: b["type"] == "toolCall"), tool)), _one(_event(message & (role == "assistant") & stop.isin("stop", "length", "error", "aborted"), "rest")),
        F.when(message & (role == "toolResult"), _one(result)),
    )
    return _rows(lines, "pi", events)


EVENTS = {"claude": claude, "codex": codex, "pi": pi}
