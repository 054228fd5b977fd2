"""Ordered classifiers of failures, commands, prompts and results, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The texts that mark a class of failure, in order of precedence.
FAILURES = (
    ("validation_error", r"InputValidationError|invalid (input|argument|param|value|json)|failed to parse|validation (error|failed)|is required|unexpected (argument|keyword|token)|usage:|unknown (option|flag|argument)"),
    ("not_found", r"no such file|not found|does not exist|ENOENT|404|unknown (command|revision|model)|could not find|cannot find"),
    ("permission", r"permission denied|EACCES|EPERM|operation not permitted|\b401\b|\b403\b|unauthori[sz]ed|forbidden|access denied|authentication (failed|required)"),
    ("network", r"connection (refused|reset|closed|timed out)|could not resolve|name or service not known|network (is )?unreachable|ECONN|ETIMEDOUT|EHOSTUNREACH|TLS|SSL|\b50[234]\b|temporary failure in name resolution|timed out"),
)
# Words that begin an informative line of a failed tool's output.
ERROR_WORDS = r"error|exception|fatal|traceback|panic|failed|failure|denied|not found|no such|refused|invalid|cannot|could not|unable to|timed out|timeout|forbidden|unauthori[sz]ed|conflict|rejected"
# Commands that only look (status) and that only pass time (wait).
STATUS_COMMANDS = (
    r"gh (run|pr) (view|list|checks|status)|gh api [^\n]*(actions/runs|check-runs|pulls)|git (fetch|log|status|rev-parse|ls-remote|worktree list)|backlog task (list|view)|list_agents"
    r"|\b(cat|tail|head|sed -n|wc)\b[^\n]{0,160}(state-|report-|outcomes-|\.notified|\.claim|lane|loop\d|wave\d)|\bps\b|pgrep|curr_time"
)
WAIT_COMMANDS = r'write_stdin\(\{[^}]*chars:\s*""|"chars":\s*""|tools\.wait\(|\bsleep\s+\d|tools\.sleep|setTimeout|wait_agent|gh run watch|--watch\b|\buntil\b[^\n]{0,200}\bdo\b|while [^\n]{0,200}sleep|timeout \d+ .*(tail -f|wait)'
CLOCK_CELL = r"^\s*const r\s*=\s*await tools\.clock__curr_time\(\{\}\);\s*text\(r\)\s*$"
COMMAND_FIELD = r'cmd:\s*"((?:[^"\\]|\\[^\n])*)"'
# Classes and origins of the owner's own words, and control commands that are typed but aren't prompts.
PROMPT_CLASSES = ("human_prompt", "queued_prompt")
PROMPT_ORIGINS = ("typed", "pasted", "launch_message", "slash_command", "skill")
CONTROL_COMMANDS = (
    "model effort clear compact plugin plugins config login logout status cost context resume exit quit help mcp permissions hooks agents memory init doctor "
    "fast vim theme output-style add-dir export rewind usage statusline terminal-setup ide upgrade bashes todos release-notes privacy-settings feedback bug "
    "remote-control rename copy keybindings sandbox tasks skills stickers migrate-installer install-github-app pr-comments security-review artifacts "
    "extra-usage passes mobile chrome advisor"
).split()
PROCESS_EXIT = r'Process exited with code -?[0-9]+|"?exit_code"?\s*:\s*-?[0-9]+'


def _ci(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(f"(?is)({pattern})"), F.lit(False))


def failure_class(denial: Column, timed_out: Column, interrupted: Column, exit_code: Column, is_error: Column, outcome: Column, excerpt: Column) -> Column:
    """The class of a failed call; null if it didn't fail."""
    no = F.lit(False)
    flag = lambda c: F.coalesce(c, no)
    says = lambda *words: flag(outcome.isin(*words))
    exited = F.coalesce(exit_code, F.lit(0)) != 0
    failed = flag(is_error) | exited | flag(timed_out) | flag(interrupted) | denial.isNotNull() | says("error", "denied", "interrupted", "timeout")
    named = (
        F.when(denial.isNotNull() | says("denied"), "denied")
        .when(flag(timed_out) | says("timeout"), "timeout")
        .when(flag(interrupted) | says("interrupted") | flag(exit_code == 130), "interrupted")
    )
    for name, pattern in FAILURES:
        named = named.when(_ci(excerpt, pattern), name)
    return F.when(failed, named.when(exited, "nonzero_exit").when(flag(is_error) | says("error"), "tool_error").otherwise("other"))


def text_failure_class(text: Column) -> Column:
    """The failure class that a text alone speaks for; 'other' if none."""
    named = F
    for name, pattern in FAILURES:
        named = named.when(_ci(text, pattern), name)
    return named.otherwise("other")


def error_excerpt(stderr: Column, output: Column, width: int = 500) -> Column:
    """About width characters from the line of the first error-like word (at most 160 back), else stderr's end, else the head."""
    err = F.nullif(F.btrim(F.coalesce(stderr, F.lit(""))), F.lit(""))
    t = F.coalesce(err, F.nullif(F.btrim(F.coalesce(output, F.lit(""))), F.lit("")))
    before = F.regexp_extract(F.substring(t, 1, 200_000), rf"(?is)^(.*?)(?:{ERROR_WORDS})", 1)
    found = _ci(F.substring(t, 1, 200_000), ERROR_WORDS)
    tail = F.right(before, F.lit(160))
    line = F.length(F.substring_index(tail, "\n", -1))
    return F.when(found, F.substr(t, F.length(before) - line + 1, F.lit(width))).when(err.isNotNull(), F.right(t, F.lit(width))).otherwise(F.left(t, F.lit(width)))


def command_class(t: Column) -> Column:
    """noop, status, wait or work for a shell command or a code-mode cell."""
    commands = F.regexp_extract_all(t, F.lit(COMMAND_FIELD), F.lit(1))
    looking = F.when(F.size(commands) > 0, F.forall(commands, lambda c: c.rlike(STATUS_COMMANDS))).otherwise(t.rlike(STATUS_COMMANDS))
    return (
        F.when(t.isNull() | (t == ""), "noop")
        .when(~t.contains("tools.") & ~t.contains("$") & (F.length(t) < 80), "noop")
        .when(t.rlike(CLOCK_CELL), "status")
        .when(t.rlike(f"(?s){WAIT_COMMANDS}"), "wait")
        .when(looking, "status")
        .otherwise("work")
    )


def genuine_prompt(message_class: Column, origin: Column, text: Column) -> Column:
    """Whether a message is the owner's own words."""
    control = r"(?i)<command-name>\s*/?(" + "|".join(CONTROL_COMMANDS) + r")\s*</command-name>"
    own = message_class.isin(*PROMPT_CLASSES) & F.coalesce(origin, F.lit("typed")).isin(*PROMPT_ORIGINS)
    return own & ~(F.coalesce(origin == "slash_command", F.lit(False)) & F.coalesce(text, F.lit("")).rlike(control))


def truthy(json: Column, path: str) -> Column:
    """Whether a JSON text has a value at the path other than null, false, 0, '' and empty."""
    v = F.get_json_object(json, path)
    return F.coalesce(~v.isin("", "false", "0", "null", "[]", "{}"), F.lit(False))


def result_class(agent: Column, tool: Column, args: Column, result: Column) -> Column:
    """What a tool call was for: work, wait, event, status, orchestrate, human, noop. args and result are JSON or plain text."""
    field = lambda *names: F.coalesce(*[F.get_json_object(args, f"$.{n}") for n in names])
    is_json = F.try_parse_json(args).isNotNull()
    command = F.when(is_json, F.coalesce(field("cmd", "command", "script"), F.lit(""))).otherwise(args)
    bare = F.regexp_replace(tool, r"^.*[.]", "")
    exited = F.coalesce(result.rlike(PROCESS_EXIT), F.lit(False))
    codex = (
        F.when(bare.isin("wait", "sleep", "wait_agent"), F.when(((bare == "wait_agent") & (F.get_json_object(result, "$.timed_out") == "false")) | ((bare != "wait_agent") & exited), "event").otherwise("wait"))
        .when(bare.isin("list_agents", "get_goal"), "status")
        .when(bare.isin("spawn_agent", "send_message", "followup_task", "interrupt_agent"), "orchestrate")
        .when(bare.isin("request_user_input", "request_user_input_async"), "human")
        .when(
            bare.isin("exec", "exec_command", "js", "run", "shell", "write_stdin"),
            F.when(command_class(command) != "wait", command_class(command)).when(command.rlike("tools[.]sleep|setTimeout"), "wait").when(exited, "event").otherwise("wait"),
        )
        .otherwise("work")
    )
    stopped = truthy(result, "$.interrupted") | truthy(result, "$.timedOutAfterMs") | truthy(result, "$.backgroundTaskId")
    shell = F.coalesce(field("command"), F.lit(""))
    shell_class = command_class(F.concat(F.lit("tools."), shell))
    state = F.coalesce(F.get_json_object(result, "$.task.status"), F.get_json_object(result, "$.status"))
    claude = (
        F.when(tool == "TaskOutput", F.when(state.isin("running", "pending"), "wait").otherwise("event"))
        .when(tool.isin("BashOutput", "Monitor", "ScheduleWakeup", "Sleep"), F.when(stopped, "wait").otherwise("event"))
        .when(tool.isin("TaskList", "TaskGet", "ListAgents"), "status")
        .when(tool.isin("Agent", "Task", "SendMessage", "TaskStop", "KillShell", "Workflow", "TeamCreate"), "orchestrate")
        .when(tool == "AskUserQuestion", "human")
        .when(
            tool == "Bash",
            F.when(truthy(args, "$.run_in_background"), "work").when(shell_class == "wait", F.when(F.lower(shell).rlike(r"^\s*sleep|;\s*sleep|until |while ") | stopped, "wait").otherwise("event")).otherwise(shell_class),
        )
        .otherwise("work")
    )
    action = field("action")
    pi = (
        F.when(tool == "bash", shell_class)
        .when(
            tool == "subagent",
            F.when(action.isin("list", "status"), "status")
            .when(action == "wait", F.when(truthy(result, "$.results"), "event").otherwise("wait"))
            .when(field("workflowScript").isNotNull() | action.isin("run", "start", "spawn") | truthy(args, "$.tasks"), "orchestrate")
            .otherwise("work"),
        )
        .when(tool.isin("watch_start", "wake_at"), "orchestrate")
        .otherwise("work")
    )
    return F.when(agent == "codex", codex).when(agent == "claude", claude).when(agent == "pi", pi)
