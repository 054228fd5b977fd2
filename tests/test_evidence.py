"""Evidence in logs, on records written here."""

import datetime as dt
import json

from loomlog.sources import evidence


def lines_of(spark, files):
    rows = [(path, 100 * i, json.dumps(r)) for path, records in files.items() for i, r in enumerate(records)]
    return spark.createDataFrame(rows, "path string, byte_offset long, raw string")


def at(s, ms=0):
    return f"2026-01-01T00:00:{s:02d}.{ms:03d}Z"


def record(kind, s, ms=0, ordinal=None, **payload):
    return {"type": kind, "timestamp": at(s, ms), **({} if ordinal is None else {"ordinal": ordinal}), "payload": payload}


def test_replay(spark):
    burst = [
        record("session_meta", 0, id="child", forked_from_id="parent"),
        record("event_msg", 0, 10, type="task_started"),
        record("response_item", 0, 20, type="message"),
        record("event_msg", 0, 30, type="task_started"),
        record("turn_context", 0, 40, model="m"),
        record("response_item", 0, 50, type="message"),
        record("response_item", 5, type="message"),
        record("event_msg", 6, type="task_started"),
    ]
    numbered = [record("session_meta", 0, id="n", forked_from_id="p", subagent_history_start_ordinal=2), record("response_item", 1, ordinal=1), record("response_item", 1, ordinal=2), record("token_usage_record", 9, ordinal=3, thread_id="p"), record("token_usage_record", 9, ordinal=4, thread_id="n")]
    plain = [record("session_meta", 0, id="x"), record("event_msg", 0, type="task_started"), record("response_item", 0, type="message")]
    got = {}
    for r in evidence.without_replay(lines_of(spark, {"burst": burst, "numbered": numbered, "plain": plain})).collect():
        got.setdefault(r.path, []).append(r.byte_offset // 100)
    assert {k: sorted(v) for k, v in got.items()} == {"burst": [0, 3, 4, 6, 7], "numbered": [0, 2, 4], "plain": [0, 1, 2]}


def test_cumulative_usage(spark):
    sample = lambda s, total, last: record("event_msg", s, type="token_count", info={"total_token_usage": {"input_tokens": total}, "last_token_usage": {"input_tokens": last, "cached_input_tokens": 1, "output_tokens": 2}})
    got = evidence.changed_usage(lines_of(spark, {"a": [sample(0, 10, 10), sample(1, 10, 10), sample(2, 30, 20), sample(3, 5, 5)]})).collect()
    assert sorted((r.byte_offset, r.input_tokens, r.cached_tokens, r.output_tokens) for r in got) == [(0, 9, 1, 2), (200, 19, 1, 2), (300, 4, 1, 2)]


def test_turns_and_spawns(spark):
    t = lambda s: dt.datetime(2026, 1, 1, 0, 0, s)
    messages = spark.createDataFrame([("claude", "s", "p", 0, t(0), "assistant_text", "e0"), ("claude", "s", "p", 1, t(1), "human_prompt", "e1"), ("claude", "s", "p", 5, t(5), "human_prompt", "e5")], "agent string, session_uid string, path string, byte_offset long, ts timestamp, message_class string, event_uid string")
    calls = spark.createDataFrame([("claude", "s", "p", 2, t(2)), ("claude", "s", "p", 6, t(6))], "agent string, session_uid string, path string, byte_offset long, ts timestamp")
    fields = "agent string, session_uid string, call_uid string, tool_name string, args string, ts timestamp, path string, byte_offset long, result_ts timestamp, is_error boolean, output string"
    tools = spark.createDataFrame(
        [
            ("claude", "s", "t1", "Task", '{"subagent_type": "scout", "description": "look", "run_in_background": true}', t(3), "p", 3, t(4), False, "ok"),
            ("claude", "s", "t2", "Agent", "{}", t(7), "p", 7, None, None, None),
            ("pi", "q", "t3", "subagent", '{"action": "list"}', t(1), "p", 1, t(2), True, ""),
            ("claude", "s", "t4", "Bash", '{"command": "git commit -m \'x\' && git push"}', t(8), "p", 8, t(9), False, "[main abc1234] x\n 1 file changed\n[main 0123456789] y"),
            ("claude", "s", "t5", "Bash", '{"command": "echo git commit"}', t(8), "p", 9, t(9), False, "[main abc1234] x"),
            ("claude", "s", "t6", "Bash", '{"command": "git push"}', t(8), "p", 10, t(9), True, "rejected"),
        ],
        fields,
    )
    got = {r.turn_no: (r.prompt_uid, r.calls, r.tool_calls) for r in evidence.turns(messages, calls, tools.filter("agent = 'claude'")).collect()}
    assert got == {0: (None, 0, 0), 1: ("e1", 1, 1), 2: ("e5", 1, 4)}
    named = lines_of(spark, {"p": [{"message": {"content": [{"type": "tool_result", "tool_use_id": "t1"}]}, "toolUseResult": {"agentId": "a7"}}, {"type": "user"}]})
    found = {r.spawn_uid: (r.requested_type, r.background, r.completion, r.child_agent_id) for r in evidence.spawns(tools, named).collect()}
    assert found == {"t1": ("scout", True, "returned", "a7"), "t2": ("general-purpose", False, None, None)}
    events = sorted((r.event_uid, r.op, r.sha_short) for r in evidence.git_evidence(tools.union(tools)).collect())
    assert events == [("t4:commit:0123456", "commit", "0123456789"), ("t4:commit:abc1234", "commit", "abc1234"), ("t4:push", "push", None)]


def test_notices_and_state(spark):
    t = dt.datetime(2026, 1, 1)
    note = "<task-notification><task-id> b1 </task-id><status>completed</status><tool_uses>3</tool_uses></task-notification>"
    messages = spark.createDataFrame([("claude", "s", t, note), ("claude", "s", t, note), ("claude", "s", t, "no " + note)], "agent string, session_uid string, ts timestamp, text string")
    assert [(r.task_id, r.call_uid, r.status, r.tool_uses) for r in evidence.notifications(messages).collect()] == [("b1", None, "completed", 3)]
    state = [{"type": "custom-title", "sessionId": "s", "customTitle": "mine"}, {"type": "ai-title", "sessionId": "s", "aiTitle": "theirs"}, {"type": "permission-mode", "sessionId": "s", "permissionMode": "plan"}, {"type": "permission-mode", "sessionId": "s", "permissionMode": "auto"}, {"type": "ai-title", "sessionId": "r", "aiTitle": "one"}]
    assert {r.session_uid: (r.title, r.permission_mode) for r in evidence.session_state(lines_of(spark, {"p": state})).collect()} == {"s": ("mine", "auto"), "r": ("one", None)}


def test_sidecars_and_permissions(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"n": 1, "s": "x"}')
    (tmp_path / "b.json").write_text("[1]")
    (tmp_path / "c.json").write_text("{")
    (tmp_path / "d.json").write_text('{"s": "' + "y" * evidence.SIDECAR_BYTES + '"}')
    good, bad = evidence.sidecars(spark, str(tmp_path), "n int, s string")
    assert [(r.value.n, r.value.s) for r in good.collect()] == [(1, "x")]
    assert {r.path.rsplit("/", 1)[1]: r.issue for r in bad.collect()} == {"b.json": "not_object", "c.json": "json_error", "d.json": "too_large"}
    log = lines_of(spark, {"p": [{"timestamp": at(1), "tool_name": "Bash", "tool_input": {"command": "sudo rm -r x"}, "reason": "no"}, {"other": 1}]})
    assert [(r.tool_name, r.cmd_verb, r.reason) for r in evidence.permissions(log).collect()] == [("Bash", "rm", "no")]


def test_lane_returns(spark):
    block = lambda s, tag="json": f"```{tag}\n{s}\n```"
    texts = [
        (1, "report\n" + block('{"status": "done", "task_id": "K-1", "version": 2}')),
        (2, (block('{"status": "open"}', "") + "\n" + block('{"status": "late", "task": "K-2"}')).replace("\n", "\r\n")),
        (3, block("not json") + "\n" + block('{"other": 1}')),
        (4, '{"status": "bare"}'),
        (5, None),
    ]
    from loomlog.plans import loops

    got = {r.event_uid: (r.status, r.task_id, r.version) for r in loops.lane_returns(spark.createDataFrame(texts, "event_uid int, text string")).collect()}
    assert got == {1: ("done", "K-1", 2), 2: ("late", "K-2", None)}
