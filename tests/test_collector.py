"""Counters of three harnesses' logs: by hand, in parts as at once, over restarts, and lanes closed by silence."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomlog.sources import activity, logs
from loomlog.streaming import collector

BEGIN = datetime(2026, 1, 1)
at = lambda s: (BEGIN + timedelta(seconds=s)).isoformat() + "Z"


def codex():
    event = lambda s, p: {"timestamp": at(s), "type": "event_msg", "payload": p}
    item = lambda s, p: {"timestamp": at(s), "type": "response_item", "payload": p}
    call = lambda s, i, name, args: item(s, {"type": "function_call", "call_id": i, "name": name, "arguments": json.dumps(args)})
    out = lambda s, i, text: item(s, {"type": "function_call_output", "call_id": i, "output": text})
    usage = lambda s, n: {"timestamp": at(s), "type": "token_usage_record", "payload": {"usage": {"input_tokens": n, "cached_input_tokens": 5, "output_tokens": 2}}}
    return [
        {"timestamp": at(0), "type": "session_meta", "payload": {"id": "c-root", "source": "cli"}},
        event(0, {"type": "task_started"}),
        {"timestamp": at(0), "type": "turn_context", "payload": {"model": "small"}},
        event(1, {"type": "user_message", "message": "Contract: loop-v2.1 go"}),
        item(1, {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "Contract: loop-v2.1 go"}]}),
        event(4, {"type": "token_count", "info": {"total_token_usage": {"total_tokens": 10}, "last_token_usage": {"input_tokens": 10, "output_tokens": 1}}}),
        usage(5, 30),
        call(6, "p", "exec_command", {"cmd": "git push origin main && just test"}),
        out(16, "p", "Process exited with code 0\nOutput: done"),
        usage(20, 40),
        call(21, "s1", "spawn_agent", {"model": "big", "reasoning_effort": "high", "agent_type": "lane", "fork_turns": "all"}),
        out(22, "s1", '{"agent_id": "x"}'),
        call(23, "s2", "spawn_agent", {}),
        out(24, "s2", "error: agent thread limit reached"),
        call(25, "w", "wait_agent", {"timeout_ms": 9000}),
        out(35, "w", '{"timed_out": true}'),
        usage(36, 50),
        call(37, "w2", "wait_agent", {"timeout_ms": 1000}),
        out(38, "w2", '{"timed_out": false}'),
        usage(39, 60),
        call(40, "b", "exec_command", {"cmd": "make ci"}),
        out(41, "b", "Process running with session ID 77"),
        call(42, "q", "write_stdin", {"session_id": 77, "chars": "", "yield_time_ms": 500}),
        out(50, "q", "Process exited with code 2"),
        item(51, {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "<environment>no</environment>"}]}),
        item(52, {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "hurry"}]}),
        {"timestamp": at(53), "type": "compacted", "payload": {}},
        event(60, {"type": "turn_aborted", "reason": "interrupted"}),
        event(100, {"type": "task_started"}),
        event(110, {"type": "token_count", "info": {"total_token_usage": {"total_tokens": 99}, "last_token_usage": {"input_tokens": 7, "output_tokens": 1}}}),
        event(120, {"type": "task_complete", "error": {"message": "You hit your usage limit"}}),
    ]


def claude(sub=False):
    base = {"sessionId": "k1"} | ({"agentId": "lane1"} if sub else {})
    said = lambda s, i, content, stop=None, n=10: {**base, "type": "assistant", "timestamp": at(s), "message": {"id": i, "model": "opus", "stop_reason": stop, "content": content, "usage": {"input_tokens": n, "cache_read_input_tokens": 90, "output_tokens": 3}}}
    use = lambda i, name, args: {"type": "tool_use", "id": i, "name": name, "input": args}
    back = lambda s, i, text, error=False, **more: {**base, "type": "user", "timestamp": at(s), "message": {"content": [{"type": "tool_result", "tool_use_id": i, "is_error": error, "content": text}]}, **more}
    return [
        {**base, "type": "user", "timestamp": at(0), "message": {"content": "please"}},
        said(3, "m1", [use("a", "Bash", {"command": "make test"})], "tool_use"),
        said(3, "m1", [use("b", "Agent", {"subagent_type": "plug:scout", "model": "haiku"})], "tool_use"),
        back(13, "a", "boom", True),
        back(14, "b", "fine", toolUseResult={"agentId": "lane1"}),
        said(16, "m2", [use("t", "TaskOutput", {"task_id": "lane1"})], "tool_use"),
        back(26, "t", "still", toolUseResult={"task": {"status": "running"}}),
        {**base, "type": "system", "subtype": "compact_boundary", "timestamp": at(27)},
        {**base, "type": "user", "isCompactSummary": True, "timestamp": at(27), "message": {"content": "summary"}},
        said(30, "m3", [{"type": "text", "text": "done"}], "end_turn"),
        {**base, "type": "user", "timestamp": at(90), "message": {"content": [{"type": "text", "text": "[Request interrupted by user]"}]}},
        {**base, "type": "assistant", "timestamp": at(91), "isApiErrorMessage": True, "error": "overloaded", "message": {"model": "<synthetic>"}},
        {**base, "type": "user", "timestamp": at(92), "message": {"content": "again"}},
        {**base, "type": "system", "subtype": "turn_duration", "timestamp": at(95)},
    ]


def pi():
    say = lambda s, m: {"type": "message", "timestamp": at(s), "message": m}
    call = lambda s, i, name, args, stop="toolUse": say(s, {"role": "assistant", "model": "mid", "stopReason": stop, "content": [{"type": "toolCall", "id": i, "name": name, "arguments": args}], "usage": {"input": 5, "output": 6, "cacheRead": 1}})
    result = lambda s, i, text, error=False, **details: say(s, {"role": "toolResult", "toolCallId": i, "isError": error, "content": [{"type": "text", "text": text}], "details": details})
    return [
        {"type": "session", "id": "p1", "timestamp": at(0)},
        say(1, {"role": "user", "content": [{"type": "text", "text": "hi"}]}),
        call(2, "k1", "subagent", {"action": "run", "tasks": [1]}),
        result(9, "k1", "ok", runId="r", results=[{"agent": "scout", "sessionFile": "f"}, {"agent": "lane", "exitCode": 3}]),
        call(10, "k2", "watch_process", {"command": "gh run watch 1", "deadline_s": 60}),
        result(40, "k2", "green", deadline_hit=False, exit_code=0),
        {"type": "custom_message", "customType": "loop-wake", "timestamp": at(50)},
        say(52, {"role": "assistant", "model": "mid", "stopReason": "stop", "content": [], "usage": {"input": 5, "output": 6}}),
    ]


def old_codex():
    """Without usage records, running totals stand for calls."""
    event = lambda s, p: {"timestamp": at(s), "type": "event_msg", "payload": p}
    total = lambda s, n: event(s, {"type": "token_count", "info": {"total_token_usage": {"total_tokens": n}, "last_token_usage": {"input_tokens": 7, "cached_input_tokens": 2, "output_tokens": 1}}})
    return [{"timestamp": at(0), "type": "session_meta", "payload": {"id": "c-old"}}, event(0, {"type": "task_started"}), event(1, {"type": "user_message", "message": "go"}), total(2, 10), total(3, 10), total(5, 20), event(10, {"type": "task_complete"})]


FILES = {("codex", "s/root"): codex(), ("codex", "s/old"): old_codex(), ("claude", "p/k1"): claude(), ("claude", "p/k1/subagents/agent-lane1"): claude(True), ("pi", "s/p1"): pi()}


def put(folder, part=lambda records: records, more=()):
    for (agent, name), records in [*FILES.items(), *more]:
        path = folder / agent / f"{name}.jsonl"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes("".join(json.dumps(r) + "\n" for r in part(records)).encode())


def events(lines, agents=("claude", "codex", "pi")):
    out = None
    for agent in agents:
        own = activity.EVENTS[agent](lines.filter(F.col("path").contains(f"/{agent}/")))
        out = own if out is None else out.unionByName(own)
    return out


def told(increments, *by):
    return {(r.metric, tuple(sorted(r["labels"].items()))): round(r.value, 6) for r in collector.totals(increments, *by).collect()}


def test_counters_by_hand(spark, tmp_path):
    put(tmp_path)
    lines, _ = logs.log_lines(spark, str(tmp_path))
    got = told(collector.collected_at_once(events(lines)), "agent")
    get = lambda metric, **labels: got.get((f"agent_efficiency_{metric}", tuple(sorted(labels.items()))), 0)
    root = {"agent": "codex", "role": "root"}
    c = {"agent": "codex"}
    assert get("llm_calls_total", **c, role="solo", trigger="user") == 2 and get("llm_calls_total", **c, role="solo", trigger="noop") == 1 and get("llm_calls_total", **c, role="solo", trigger="model") == 1
    assert get("llm_calls_total", **root, trigger="wait") == 1 and get("llm_calls_total", **root, trigger="event") == 1 and get("llm_calls_total", **root, trigger="user") == 0  # records replace running totals
    assert get("root_llm_calls_by_protocol_total", **c, protocol="v2.1", poll="true") == 1 and get("root_llm_calls_by_protocol_total", **c, protocol="v2.1", poll="false") == 3 and get("root_llm_calls_by_protocol_total", **c, protocol="none", poll="false") == 2
    assert get("input_tokens_total", **root, trigger="wait", cache="hit") == 5 and get("input_tokens_total", **root, trigger="wait", cache="miss") == 45
    assert get("git_pushes_total", **c, role="solo", outcome="success") == 1 and get("gate_runs_total", **c, role="solo", outcome="success") == 1
    assert get("gate_runs_total", **root, outcome="failure") == 1 and get("tool_failures_total", **root, **{"class": "wait"}) == 1
    assert get("spawns_total", **c) == 2 and get("spawn_errors_total", **c, kind="thread_limit") == 1
    assert get("spawns_by_route_total", **root, spawn_model="big", effort="high", agent_type="lane", fork="all") == 1
    assert get("poll_calls_total", **root, target="agent", result="timed_out") == 1 and get("poll_seconds_total", **root, target="agent", result="timed_out") == 10
    assert get("poll_calls_total", **root, target="gate", result="event") == 1 and get("wait_timeout_ms_total", **root, tool="wait_agent") == 10_000 and get("wait_requests_total", **root, tool="write_stdin") == 1
    assert get("compactions_total", **root) == 1 and get("interventions_total", **root, kind="user_message") == 1 and get("interventions_total", **root, kind="interrupt") == 1
    assert get("turn_errors_total", **c, kind="aborted") == 1 and get("turn_errors_total", **c, kind="usage_limit") == 1
    assert get("time_seconds_total", **root, state="idle") == 40 and get("time_seconds_total", **root, state="tool_wait") == 19 and get("time_seconds_total", **c, role="solo", state="tool_noop") == 10
    assert sum(v for (m, labels), v in got.items() if m.endswith("efficiency_time_seconds_total") and ("agent", "codex") in labels) == 130
    assert get("first_spawn_seconds_sum", **c) == 21 and get("first_spawn_seconds_bucket", **c, le="60") == 1

    k = {"agent": "claude", "role": "root"}
    assert get("llm_calls_total", agent="claude", role="solo", trigger="user") == 1 and get("llm_calls_total", agent="claude", role="worker", trigger="user") == 2
    assert get("gate_runs_total", **k, outcome="failure") == 1 and get("compactions_total", **k) == 1 and get("model_calls_total", **k, model="opus") == 2
    assert get("spawns_by_route_total", **k, spawn_model="haiku", effort="inherit", agent_type="scout", fork="none") == 1
    assert get("poll_calls_total", **k, target="agent", result="timed_out") == 1 and get("turn_errors_total", agent="claude", kind="upstream") == 2
    assert get("interventions_total", **k, kind="interrupt") == 1 and get("interventions_total", **k, kind="user_message") == 1
    assert get("time_seconds_total", **k, state="idle") == 60

    p = {"agent": "pi", "role": "root"}
    assert get("spawns_total", agent="pi") == 1 and get("spawn_errors_total", agent="pi", kind="other") == 1 and get("poll_calls_total", **p, target="ci", result="event") == 1
    assert get("wait_timeout_ms_total", **p, tool="watch_process") == 60_000 and get("llm_calls_total", **p, trigger="event") == 1 and get("first_spawn_seconds_sum", agent="pi") == 2


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, old)


def test_parts_and_restarts_are_one_read(spark, rocks, tmp_path):
    spark.dataSource.register(logs.LogSource)
    root, out = tmp_path / "logs", str(tmp_path / "out")

    def run():
        stream = spark.readStream.format("agentlogs").option("path", str(root)).load().filter("raw IS NOT NULL")
        query = collector.collected(events(stream, ("claude", "codex", "pi"))).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    put(root, lambda records: records[: len(records) // 2])
    run()
    put(root)
    run()
    found = spark.read.parquet(out)
    lines, _ = logs.log_lines(spark, str(root))
    assert told(found.filter("metric <> 'agent_efficiency_lane_seconds'"), "agent", "thread") == told(collector.collected_at_once(events(lines)), "agent", "thread")
    # another thread's later records move the watermark: the silent lane is closed, once
    late = [{"sessionId": "k2", "type": "user", "timestamp": at(d * 86_400), "message": {"content": "x"}} for d in (2, 3)]
    put(root, more=[(("claude", "p/k2"), late)])
    run()
    put(root, more=[(("claude", "p/k3"), late)])
    run()
    lanes = spark.read.parquet(out).filter("metric = 'agent_efficiency_lane_seconds'").collect()
    assert [(r.uid, r.amount) for r in lanes] == [("lane1", 95.0)]
