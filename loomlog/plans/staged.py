"""The session catalogue's tables made from the event stream, so that the catalogue's own views can be run and checked on it.

Users stand for sessions, event kinds for model calls, tool calls and messages, and the number in props for what varies. The
same tables are written twice, as DataFrames and as SQL; what is checked is the views over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Prices per million tokens: model, from, input, cached, cache write, output. Model m3 has none.
PRICES = (
    ("m0", "2024-01-01", 3.0, 0.3, 3.75, 15.0),
    ("m0", "2024-01-12", 2.0, 0.2, None, 10.0),
    ("m1", "2024-01-05", 1.0, None, None, 4.0),
    ("m2", "2023-06-01", 0.5, 0.1, 0.6, 2.0),
)
#: Tools and arguments by harness and kind (k % 6), and what a call of it is for.
TOOLS = (
    ("claude", 0, "Bash", '{"command": "make"}', "work"),
    ("claude", 1, "Bash", '{"command": "sleep 5"}', "wait"),
    ("claude", 2, "TaskList", "{}", "status"),
    ("claude", 3, "Agent", '{"prompt": "go"}', "orchestrate"),
    ("claude", 4, "AskUserQuestion", "{}", "human"),
    ("claude", 5, "Bash", '{"command": "git status"}', "status"),
    ("codex", 0, "exec_command", '{"cmd": "tools.make"}', "work"),
    ("codex", 1, "wait", "{}", "wait"),
    ("codex", 2, "list_agents", "{}", "status"),
    ("codex", 3, "spawn_agent", "{}", "orchestrate"),
    ("codex", 4, "request_user_input", "{}", "human"),
    ("codex", 5, "exec_command", '{"cmd": "tools.sleep(5)"}', "wait"),
    ("pi", 0, "bash", '{"command": "make"}', "work"),
    ("pi", 1, "subagent", '{"action": "wait"}', "wait"),
    ("pi", 2, "subagent", '{"action": "list"}', "status"),
    ("pi", 3, "subagent", '{"action": "run"}', "orchestrate"),
    ("pi", 4, "watch_start", "{}", "orchestrate"),
    ("pi", 5, "bash", '{"command": "git status"}', "status"),
)
#: Outputs by k % 5, and the failure class of a failed call with it.
OUTPUTS = (
    ("all fine\n", "tool_error"),
    ("building\nmake: *** no such file\nend", "not_found"),
    ("fatal: permission denied (publickey)", "permission"),
    ("curl: connection refused", "network"),
    ("failed to parse the input", "validation_error"),
)

_values = lambda rows: ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v + "'" for v in r) + ")" for r in rows)

#: The tables as SQL, to stand before a query: sessions, messages, calls, tool_calls, prices.
WITH = f"""WITH ev AS (SELECT *, regexp_extract(props, '([0-9]+)', 1)::BIGINT AS k, ['claude', 'codex', 'pi'][user_id % 3 + 1] AS agent, 'u' || user_id AS session_uid, 'p' || (user_id % 7) || '.jsonl' AS path, event_id AS byte_offset FROM events),
prices(model, effective_from, input, cached, cache_write, output) AS (SELECT * FROM (VALUES {_values(PRICES)}) v(a, b, c, d, e, f)),
tools(agent, kind, tool_name, args, cls) AS (SELECT * FROM (VALUES {_values(TOOLS)}) v(a, b, c, d, e)),
outputs(n, output, failure) AS (SELECT * FROM (VALUES {_values([(i, *o) for i, o in enumerate(OUTPUTS)])}) v(a, b, c)),
sessions AS (SELECT agent, session_uid, min(ts) AS first_ts, max(ts) AS last_ts, '/home/x/repos/r' || (user_id % 6) AS cwd, CASE WHEN user_id % 5 <> 0 THEN 'u' || (user_id // 2) END AS parent_uid, user_id % 11 = 0 AS is_stub FROM ev GROUP BY agent, session_uid, user_id),
messages AS (SELECT agent, session_uid, 'e' || event_id AS event_uid, ts, CASE k % 3 WHEN 0 THEN 'human_prompt' WHEN 1 THEN 'assistant_text' ELSE 'injected' END AS message_class, 'text ' || k AS text, path, byte_offset FROM ev WHERE event_type = 'signup'),
calls AS (SELECT agent, session_uid, 'r' || event_id AS response_id, ts, 'm' || (event_id % 4) AS model, CASE WHEN k % 10 = 9 THEN 'usage:x' WHEN k % 10 = 8 THEN 'compaction' ELSE 'end' END AS stop_reason, k * 10 AS input_tokens, CASE WHEN event_id % 6 <> 1 THEN k END AS cached_tokens, k % 7 AS cache_write_tokens, CASE WHEN event_id % 9 <> 4 THEN floor(value)::BIGINT END AS output_tokens, path, byte_offset FROM ev WHERE event_type IN ('click', 'view')),
tool_calls AS (SELECT ev.agent, session_uid, 't' || event_id AS call_uid, tool_name, args, ts, ts + to_seconds(k) AS result_ts, event_type = 'error' AS is_error, output, path, byte_offset, cls, failure FROM ev JOIN tools ON tools.agent = ev.agent AND kind = k % 6 JOIN outputs ON n = k % 5 WHERE event_type IN ('error', 'purchase'))
"""


def _chosen(by: Column, values: list) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), by.cast("int"))


def staged(t) -> dict[str, DataFrame]:
    """sessions, messages, calls, tool_calls and prices."""
    user, k = F.col("user_id"), F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    number = lambda c: c.cast("string")
    ev = t("events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", k.alias("k"), _chosen(user % 3, ["claude", "codex", "pi"]).alias("agent"),
        text("u", number(user)).alias("session_uid"), text("p", number(user % 7), ".jsonl").alias("path"), F.col("event_id").alias("byte_offset"),
    )
    parent = F.when(user % 5 != 0, text("u", number(F.floor(user / 2))))
    sessions = ev.groupBy("agent", "session_uid", "user_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    at = ["agent", "session_uid"]
    place = ["path", "byte_offset"]
    kind = F.col("k") % 6
    tool = lambda field: F.coalesce(*[F.when(F.col("agent") == a, _chosen(kind, [r[field] for r in TOOLS if r[0] == a])) for a in ("claude", "codex", "pi")])
    i = F.col("event_id")
    return {
        "sessions": sessions.select(*at, "first_ts", "last_ts", text("/home/x/repos/r", number(user % 6)).alias("cwd"), parent.alias("parent_uid"), (user % 11 == 0).alias("is_stub")),
        "messages": ev.filter("event_type = 'signup'").select(*at, text("e", number(i)).alias("event_uid"), "ts", _chosen(F.col("k") % 3, ["human_prompt", "assistant_text", "injected"]).alias("message_class"), text("text ", number(F.col("k"))).alias("text"), *place),
        "calls": ev.filter("event_type IN ('click', 'view')").select(
            *at, text("r", number(i)).alias("response_id"), "ts", text("m", number(i % 4)).alias("model"), F.when(F.col("k") % 10 == 9, "usage:x").when(F.col("k") % 10 == 8, "compaction").otherwise("end").alias("stop_reason"), (F.col("k") * 10).alias("input_tokens"),
            F.when(i % 6 != 1, F.col("k")).alias("cached_tokens"), (F.col("k") % 7).alias("cache_write_tokens"), F.when(i % 9 != 4, F.floor("value")).alias("output_tokens"), *place,
        ),
        "tool_calls": ev.filter("event_type IN ('error', 'purchase')").select(
            *at, text("t", number(i)).alias("call_uid"), tool(2).alias("tool_name"), tool(3).alias("args"), "ts", F.timestamp_micros(F.unix_micros("ts") + F.col("k") * 1_000_000).alias("result_ts"), (F.col("event_type") == "error").alias("is_error"),
            _chosen(F.col("k") % 5, [o for o, _ in OUTPUTS]).alias("output"), *place,
        ),
        "prices": t("events").sparkSession.createDataFrame(PRICES, "model string, effective_from string, input double, cached double, cache_write double, output double").withColumn("effective_from", F.col("effective_from").cast("date")),
    }
