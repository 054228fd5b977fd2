"""Logs to tables to views, whole and in parts, on fixtures written here."""

import json

from pyspark.sql import functions as F

from loomlog.operators.merge import MergeSpec
from loomlog.plans import sessions
from loomlog.sources import jsonl, transcripts
from loomlog.streaming.refresh import Snapshots, maintain

SID = "11111111-2222-4333-8444-555555555555"


def claude_lines():
    at = lambda s: f"2026-01-01T00:{s // 60:02d}:{s % 60:02d}Z"
    base = {"sessionId": "s1", "cwd": "/home/x/repos/app", "gitBranch": "main"}
    usage = lambda n: {"input_tokens": 10, "output_tokens": n, "cache_read_input_tokens": 100}
    return [
        {**base, "type": "user", "uuid": "u1", "timestamp": at(0), "message": {"role": "user", "content": "please fix it"}},
        {**base, "type": "assistant", "uuid": "a1", "timestamp": at(5), "message": {"id": "m1", "model": "big", "content": [{"type": "text", "text": "on it"}], "usage": usage(1)}},
        {**base, "type": "assistant", "uuid": "a2", "timestamp": at(6), "message": {"id": "m1", "model": "big", "stop_reason": "tool_use", "content": [{"type": "tool_use", "id": "t1", "name": "Bash", "input": {"command": "make test"}}], "usage": usage(20)}},
        {**base, "type": "user", "uuid": "u2", "timestamp": at(9), "message": {"content": [{"type": "tool_result", "tool_use_id": "t1", "is_error": True, "content": "make: no such file"}]}},
        {**base, "type": "assistant", "uuid": "a3", "timestamp": at(20), "message": {"id": "m2", "model": "big", "content": [{"type": "text", "text": "failed"}], "usage": {"input_tokens": 0, "output_tokens": 0}}},
    ]


def codex_lines():
    item = lambda p: {"timestamp": "2026-01-02T00:00:00Z", "type": "response_item", "payload": p}
    return [
        {"timestamp": "2026-01-02T00:00:00Z", "type": "session_meta", "payload": {"id": SID, "cwd": "/w", "forked_from_id": "s1"}},
        {"timestamp": "2026-01-02T00:00:00Z", "type": "turn_context", "payload": {"model": "small"}},
        item({"type": "message", "role": "user", "content": [{"type": "input_text", "text": "go"}]}),
        item({"type": "function_call", "call_id": "c1", "name": "shell", "arguments": '{"cmd": "tools. make"}'}),
        item({"type": "function_call_output", "call_id": "c1", "output": "Process exited with code 2"}),
        {"timestamp": "2026-01-02T00:00:09Z", "type": "token_usage_record", "payload": {"response_id": "r1", "usage": {"input_tokens": 30, "cached_input_tokens": 10, "output_tokens": 4}}},
    ]


def pi_lines():
    say = lambda i, m: {"type": "message", "id": i, "timestamp": "2026-01-03T00:00:00Z", "message": m}
    return [
        {"type": "session", "id": "p1", "timestamp": "2026-01-03T00:00:00Z", "cwd": "/p"},
        say("x1", {"role": "user", "content": [{"type": "text", "text": "hi"}]}),
        say("x2", {"role": "assistant", "model": "mid", "stopReason": "toolUse", "content": [{"type": "toolCall", "id": "k1", "name": "bash", "arguments": {"command": "ls"}}], "usage": {"input": 5, "output": 6, "cacheRead": 0}}),
        say("x3", {"role": "toolResult", "toolCallId": "k1", "isError": False, "content": [{"type": "text", "text": "ok"}]}),
    ]


def write(folder, name, records):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"".join(json.dumps(r).encode() + b"\n" for r in records))
    return path


def tables(spark, tmp_path):
    lines = {}
    for agent, records in (("claude", claude_lines()), ("codex", codex_lines()), ("pi", pi_lines())):
        write(tmp_path / agent, "a/log.jsonl", records)
        lines[agent] = jsonl.read_lines(spark, str(tmp_path / agent))
    return transcripts.catalogue(lines)


def test_views(spark, tmp_path):
    t = tables(spark, tmp_path)
    calls = {r.response_id: r for r in t["calls"].collect()}
    assert (calls["m1"].input_tokens, calls["m1"].output_tokens, calls["m1"].cached_tokens, calls["m1"].stop_reason) == (10, 20, 100, "tool_use")
    assert calls["m2"].output_tokens is None and calls["r1"].input_tokens == 20 and calls["r1"].model == "small" and calls["x2"].output_tokens == 6
    tools = {r.call_uid: r for r in sessions.with_failures(t["tool_calls"]).collect()}
    assert tools["t1"].is_error and tools["t1"].error_class == "not_found" and tools["c1"].is_error and tools["k1"].error_class is None
    prices = spark.createDataFrame([("big", "2025-01-01", 1.0, None, None, 10.0), ("big", "2026-06-01", 9.0, None, None, 90.0), ("mid", "2025-01-01", 1.0, 0.5, 2.0, 1.0)], "model string, effective_from string, input double, cached double, cache_write double, output double").withColumn("effective_from", F.to_date("effective_from"))
    cost = {r.session_uid: r for r in sessions.session_cost(t["calls"], prices).collect()}
    assert abs(cost["s1"].usd - (10 + 100 + 200) / 1e6) < 1e-12 and cost[SID].usd is None and cost[SID].unpriced_calls == 1
    rolled = {r.session_uid: r for r in sessions.rollup(t["sessions"], t["messages"], t["calls"], t["tool_calls"]).collect()}
    assert (rolled["s1"].prompts, rolled["s1"].calls, rolled["s1"].tool_errors, rolled["s1"].first_prompt, rolled["s1"].project, rolled["s1"].active_seconds) == (1, 2, 1, "please fix it", "app", 20)
    tree = {r.root: r for r in sessions.session_tree(t["sessions"], sessions.rollup(t["sessions"], t["messages"], t["calls"], t["tool_calls"])).collect()}
    assert tree["s1"].sessions == 2 and tree["s1"].depth == 1 and tree["p1"].sessions == 1
    trig = {r.response_id: r.trigger for r in sessions.call_triggers(t["calls"], t["tool_calls"], t["messages"]).collect()}
    assert trig["m1"] == "human" and trig["m2"] == "work"
    assert sessions.efficiency(t["calls"], t["tool_calls"], t["messages"]).count() == 3
    assert [r.kind for r in sessions.timeline(t["messages"], t["tool_calls"], t["calls"], "s1").collect()] == ["human_prompt", "assistant_text", "call", "tool", "assistant_text", "call"]
    assert sessions.tool_reliability(t["tool_calls"], agents=["claude"]).first().error_rate == 1.0
    assert sessions.cost_report(t["calls"], prices).filter("day IS NULL").count() == 1
    dirty = spark.createDataFrame([("pi", "p1")], "agent string, session_uid string")
    assert [r.session_uid for r in sessions.rollup(t["sessions"], t["messages"], t["calls"], t["tool_calls"], dirty).collect()] == ["p1"]


def test_every_split_reads_the_same(spark, tmp_path):
    path = write(tmp_path, "log.jsonl", claude_lines())
    whole, root = path.read_bytes(), str(tmp_path)
    all_lines = sorted(tuple(r) for r in jsonl.read_lines(spark, root).collect())
    assert "".join(r[4] + "\n" for r in sorted(all_lines, key=lambda r: r[1])).encode() == whole
    for cut in (0, 1, len(whole) // 3, whole.index(b"\n") + 1, len(whole) - 1):
        path.write_bytes(whole[:cut])
        first = [tuple(r) for r in jsonl.read_lines(spark, root).collect()]
        state = spark.createDataFrame(jsonl.file_states(spark, root).collect(), jsonl.STATE)
        path.write_bytes(whole)
        rest = [tuple(r) for r in jsonl.read_lines(spark, root, state).collect()]
        assert sorted(first + rest) == all_lines
    state = spark.createDataFrame(jsonl.file_states(spark, root).collect(), jsonl.STATE)
    assert jsonl.read_lines(spark, root, state).count() == 0
    path.write_bytes(whole[: whole.index(b"\n") + 1] + b"\0" * 50)
    assert jsonl.read_lines(spark, root, state).count() == 1
    now = jsonl.file_states(spark, root)
    assert now.first().padding == 50 and jsonl.rewritten(state, now).count() == 1


def test_bad_lines_are_issues(spark, tmp_path):
    (tmp_path / "x.jsonl").write_bytes(b'{"a": 1}\n[1]\n{bad\n\n')
    good, issues = jsonl.parsed(jsonl.read_lines(spark, str(tmp_path)))
    assert good.count() == 1 and sorted(r.issue for r in issues.collect()) == ["json_error", "not_object"]


def test_roles_and_tiers(spark, tmp_path):
    for tier, names in (("hot", ["n/projects/p/s.jsonl"]), ("cold", ["n/projects/p/s.jsonl", "n/projects/p/s/subagents/agent-1.jsonl"])):
        for name in names:
            write(tmp_path / tier, name, [{}])
    found = jsonl.inventory(*(jsonl.files(spark, str(tmp_path / t)).drop("content") for t in ("hot", "cold")), f"file:{tmp_path}/hot", f"file:{tmp_path}/cold").collect()
    assert {(r.role, r.tier, r.copies, r.namespace) for r in found} == {("main", "hot", 2, "n"), ("subagent", "cold", 1, "n")}


def test_maintained_table(spark, tmp_path):
    schema = "k int, seen int, top int"
    spec = MergeSpec(("k",), {"top": "MAX"}, "seen")
    source = str(tmp_path / "in")
    for i, rows in enumerate([[(1, 1, 5), (2, 1, 1)], [(1, 2, 3), (3, 2, 9)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        q = maintain(spark.readStream.schema(schema).parquet(source), spec, str(tmp_path / "t"), str(tmp_path / "feed"), str(tmp_path / "c"))
        q.awaitTermination(120)
        assert q.exception() is None and Snapshots(spark, str(tmp_path / "t")).versions()[-1] == i
    table = Snapshots(spark, str(tmp_path / "t"))
    assert sorted(tuple(r) for r in table.read().select("k", "top").collect()) == [(1, 5), (2, 1), (3, 9)]
    assert not table.upsert(spark.createDataFrame([(9, 9, 9)], schema), spec, 1)
    assert sorted((r.version, r.k) for r in spark.read.parquet(str(tmp_path / "feed")).collect()) == [(0, 1), (0, 2), (1, 1), (1, 3)]
