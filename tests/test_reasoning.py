"""Thoughts that are written twice, in either order, lost, encrypted or equal."""

import json

from loomlog.sources import reasoning


def test_thoughts(spark):
    event = lambda **p: {"type": "event_msg", "payload": p}
    item = lambda **p: {"type": "response_item", "payload": p}
    part = lambda text: event(type="agent_reasoning", text=text)
    raw = lambda text: event(type="agent_reasoning_raw_content", text=text)
    own = lambda *texts, **more: item(type="reasoning", summary=[{"type": "summary_text", "text": t} for t in texts], **more)
    turn = lambda t: event(type="task_started", turn_id=t)
    message = item(type="message", role="assistant", content=[])
    files = {
        "before": [turn("t"), part("a"), part("b"), own("a", "b")],
        "after": [turn("t"), own("a", "b"), part("a"), part("b"), message],
        "encrypted": [turn("t"), part("a"), raw("deep"), own(encrypted_content="x"), own(encrypted_content="y")],
        "item_lost": [turn("t"), part("a"), message, part("c"), event(type="task_complete")],
        "parts_lost": [turn("t"), own("a", content=[{"text": "r"}])],
        "completed": [turn("t"), event(type="item_completed", item={"type": "Reasoning", "summary_text": ["a"], "raw_content": ["r"]}), own()],
        "three_equal": [turn("t"), own("a"), own("a"), own("a"), turn("u"), own("a")],
        "subset": [turn("t"), own("a", "b"), own("b"), own("a"), own("a", "c")],
        "stale": [turn("t"), own("a"), part("a"), own(encrypted_content="x")],
        "turns": [turn("t"), part("a"), turn("u"), own("b")],
        "blank": [turn("t"), part("  "), own("")],
        "end": [turn("t"), part("a")],
    }
    rows = [(name, n * 10, json.dumps({"timestamp": f"2026-01-01T00:00:{n:02d}Z", **r})) for name, records in files.items() for n, r in enumerate(records)]
    rows += [("broken", 0, "{no"), ("broken", 10, None)]
    lines = spark.createDataFrame(rows, "path string, byte_offset long, raw string").repartition(3)
    got = {}
    for r in reasoning.reasoning(lines).orderBy("path", "byte_offset").collect():
        got.setdefault(r.path, []).append((r.byte_offset, r.turn_id, r.text, r.source, r.summary_parts, r.raw_parts))
    assert got == {
        "before": [(30, "t", "a\n\nb", "response_item", 2, 0)],
        "after": [(10, "t", "a\n\nb", "response_item", 2, 0)],
        "encrypted": [(30, "t", "a\n\ndeep", "event_msg", 1, 1)],
        "item_lost": [(10, "t", "a", "event_msg", 1, 0), (30, "t", "c", "event_msg", 1, 0)],
        "parts_lost": [(10, "t", "a\n\nr", "response_item", 1, 1)],
        "completed": [(20, "t", "a\n\nr", "item_completed", 1, 1)],
        "three_equal": [(10, "t", "a", "response_item", 1, 0), (50, "u", "a", "response_item", 1, 0)],
        "subset": [(10, "t", "a\n\nb", "response_item", 2, 0), (40, "t", "a\n\nc", "response_item", 2, 0)],
        "stale": [(10, "t", "a", "response_item", 1, 0)],
        "turns": [(10, "t", "a", "event_msg", 1, 0), (30, "u", "b", "response_item", 1, 0)],
        "end": [(10, "t", "a", "event_msg", 1, 0)],
    }
