"""State logs: what rejects a copy, conflicts, outcomes; the same in any partitioning."""

import json

from loomlog.plans import state_log

GOAL = "a" * 64
OPEN = {"ev": "open", "goal_sha256": GOAL, "tier": "routine", "root": "llm", "root_model": "m", "envelope": []}


def log(*bodies, **more):
    return [json.dumps({"v": 1, "seq": n + 1, "ts": f"2026-01-01T00:00:{n:02d}Z", "by": "root", **b, **more}) for n, b in enumerate(bodies)]


def made(spark, copies):
    return spark.createDataFrame([(c, i, line) for c, lines in copies.items() for i, line in enumerate(lines)], "copy_id string, line_no long, raw string")


PARK = {"ev": "park", "task": "t", "reason": "r", "needs": "owner"}


def test_rejections(spark):
    good = log(OPEN, PARK)
    cases = {
        "good": (good, None), "blank": ([good[0], "", "  ", good[1]], None), "torn": ([*good, '{"v": 1, "se'], None), "malformed": ([*good, '{"v": 1,}'], "malformed"), "text": ([*good, "hello"], "malformed"), "list": ([*good, "[1]"], "not_object"),
        "twice": ([good[0], good[1][:-1] + ', "task": "u"}'], "malformed"), "number": ([good[0], good[0].replace('"seq": 1', '"seq": 3')], "order"), "actor": (log(OPEN, PARK, by="me"), "framing"), "time": ([good[0].replace("00:00:00Z", "25:00:00Z")], "framing"), "version": (log(OPEN, v=1.5), "framing"),
        "goal": (log(OPEN | {"goal_sha256": "x"}), "goal"), "again": (log(OPEN, OPEN), "second_open"), "none": (log(PARK), "no_open"), "kind": (log(OPEN, {"ev": "dance"}), "schema"), "extra": (log(OPEN, PARK | {"x": 1}), "schema"),
        "missing": (log(OPEN, {"ev": "park", "task": "t", "reason": "r"}), "schema"), "word": (log(OPEN, PARK | {"needs": "luck"}), "schema"), "empty": (log(OPEN, PARK | {"task": ""}), "schema"), "type": (log(OPEN, PARK | {"task": 7}), "schema"),
        "null": (log(OPEN, {"ev": "return", "lane": "l", "run": "r", "status": "failed", "exit": None, "sha": None, "coderabbit": None}), None), "bool": (log(OPEN, {"ev": "return", "lane": "l", "run": "r", "status": "failed", "exit": True}), "schema"),
        "float": (log(OPEN, {"ev": "return", "lane": "l", "run": "r", "status": "failed", "exit": 1.5}), "schema"), "review": (log(OPEN, {"ev": "return", "lane": "l", "run": "r", "status": "failed", "coderabbit": {"ran": True, "major": 1}}), "schema"),
        "path": (log(OPEN, {"ev": "return", "lane": "l", "run": "r", "status": "failed", "artifact": "x/y"}), "schema"), "mixed": (log(OPEN | {"envelope": ["a", 1]}), "schema"), "heartbeat": (log(OPEN, {"ev": "heartbeat"}), None), "long": (log(OPEN, {"ev": "judgement", "text": "é" * 2049}), "schema"),
        "short": (log(OPEN, {"ev": "judgement", "text": "é" * 2048}), None),
    }
    lines = made(spark, {n: c[0] for n, c in cases.items()})
    for parts in (1, 5):
        found = {r.copy_id: r.rejected for r in state_log.copies(state_log.frames(lines.repartition(parts))).collect()}
        assert found == {n: c[1] for n, c in cases.items()}


def test_cohorts(spark):
    admit = lambda n: {"ev": "admit", "task": n, "source": "envelope", "owned": "o", "accept": "x"}
    land = {"ev": "land", "task": "a", "sha": "s", "gate": "g", "mode": "pre-green"}
    accept = lambda ok: {"ev": "accept", "task": "a", "accepted": ok, "reason": "r"}
    copies = {
        "one": log(OPEN, admit("a"), admit("a"), accept(False), accept(True), land, PARK),
        "prefix": log(OPEN, admit("a")),
        "reordered": [json.dumps(dict(reversed(json.loads(x).items()))) for x in log(OPEN, admit("a"))],
        "other": log(OPEN, admit("a"), admit("a"), accept(False), accept(True), land, {"ev": "close", "reason": "budget"}),
        "bad": [*log(OPEN), "junk"],
    }
    rows = state_log.frames(made(spark, copies))
    judged = state_log.copies(rows)
    assert [(r.seq, r.kinds, r.versions) for r in state_log.conflicts(rows, judged).collect()] == [(7, ["close", "park"], 2)]
    (out,) = state_log.outcomes(rows, judged).collect()
    assert (out.copies, out.rejected_copies, out.tasks_admitted, out.tasks_landed, out.tasks_accepted, out.parks, out.dispatches, out.closed_at) == (4, 1, 1, 1, 1, None, 0, None)
    nothing = state_log.frames(made(spark, {"x": ["{}"]}).limit(0))
    assert state_log.outcomes(nothing, state_log.copies(nothing)).collect() == []


def test_lines_are_read_once_a_pass(spark):
    """However many figures a run has, its lines are parsed for what they tell and for what their copies are, not once a figure."""
    rows = state_log.frames(made(spark, {"one": log(OPEN, PARK)}).repartition(2))
    plan = state_log.outcomes(rows, state_log.copies(rows))._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("LogicalRDD") <= 4


def test_odd_members(spark):
    """Names that look like others' types, types of nested members, null elements, empty texts: as strict as by members one by one."""
    back = {"ev": "return", "lane": "l", "run": "r", "status": "failed"}
    review = {"ran": True, "major": 1, "unreviewed": 0}
    cases = {
        "name": (PARK | {"lane: STRING, until": "x"}, False), "kind": ({"ev": "park needs: STRING,", "task": "t", "reason": "r"}, False), "more": (back | {"coderabbit": review | {"note": "", "of": {"x": [1, {"y": None}]}}}, True), "own": (back | {"coderabbit": review, "x": {"a": 1}}, False),
        "beside": (back | {"coderabbit": {"x": 1}, "questions": ["a"]}, False), "hole": (back | {"questions": ["a", None]}, False), "null": (back | {"questions": ["null"]}, True), "void": (back | {"questions": []}, True), "sha": (back | {"sha": ""}, False), "big": (back | {"exit": 2**70}, False),
        "path": (back | {"artifact": "/x\0"}, False), "root": (back | {"artifact": "/x"}, True), "owned": ({"ev": "admit", "task": "t", "source": "envelope", "owned": ["a", None], "accept": "x"}, True), "text": ({"ev": "admit", "task": "t", "source": "envelope", "owned": "", "accept": "x"}, False),
        "close": ({"ev": "close", "reason": "ci-red"}, False), "revert": ({"ev": "revert", "sha": "s", "reverted_by": "b", "reason": "ci-red"}, True), "beat": ({"ev": "heartbeat", "at": {"x": ""}}, True), "beats": ({"ev": "heartbeat", "on": 1}, False), "word": (PARK | {"needs": None}, False),
    }
    found = {r.copy_id: r.rejected for r in state_log.copies(state_log.frames(made(spark, {n: log(OPEN, c) for n, (c, _) in cases.items()}))).collect()}
    assert found == {n: None if good else "schema" for n, (_, good) in cases.items()}
