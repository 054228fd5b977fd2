"""The logs' further records."""

import json

from pyspark.sql import functions as F

from loomlog.sources import signals


def test_records(spark):
    rows = [
        {"type": "attachment", "sessionId": "s", "timestamp": "2026-01-01T00:00:00Z", "attachment": {"type": "hook_success", "hookName": "fmt", "hookEvent": "PostToolUse", "durationMs": 12}},
        {"type": "system", "subtype": "compact_boundary", "timestamp": "2026-01-01T01:00:00Z", "compactMetadata": {"trigger": "auto", "preTokens": 9}},
        {"type": "event_msg", "timestamp": "2026-01-01T01:00:00Z", "payload": {"type": "token_count", "rate_limits": {"primary": {"used_percent": 10, "window_minutes": 300}}}},
        {"type": "event_msg", "timestamp": "2026-01-01T03:00:00Z", "payload": {"type": "token_count", "rate_limits": {"primary": {"used_percent": 30.0, "window_minutes": 300}, "secondary": {"used_percent": 5}}}},
        {"odd": 1},
    ]
    lines = spark.createDataFrame([("p", i, json.dumps(r)) for i, r in enumerate(rows)], "path string, byte_offset long, raw string")
    assert [(r.hook_name, r.outcome, r.duration_ms) for r in signals.hook_events(lines).collect()] == [("fmt", "hook_success", 12)]
    assert [(r.trigger, r.tokens_before) for r in signals.compactions(lines).collect()] == [("auto", 9)]
    samples = signals.rate_limit_samples(lines)
    assert samples.count() == 3
    f = {r.window_kind: r for r in signals.forecast(samples).collect()}
    assert f["primary"].burn_per_hour == 10 and f["primary"].hours_left == 7 and f["secondary"].burn_per_hour is None
    half = F.col("byte_offset") < 2
    whole = {(r.type, r.subtype): r.n for r in signals.merged_census(signals.record_census(lines.filter(half)), signals.record_census(lines.filter(~half))).collect()}
    assert whole == {(r.type, r.subtype): r.n for r in signals.record_census(lines).collect()} and whole["(none)", ""] == 1
