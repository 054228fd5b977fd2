"""The command line over the fixtures of test_sessions."""

import io
import json
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from test_sessions import claude_lines, codex_lines, pi_lines, write

from loomlog.__main__ import COMMANDS, main


@pytest.fixture(scope="module")
def logs(tmp_path_factory):
    root = tmp_path_factory.mktemp("logs")
    given = []
    for agent, records in (("claude", claude_lines()), ("codex", codex_lines()), ("pi", pi_lines())):
        write(root / agent, "a.jsonl", records)
        given += ["--logs", f"{agent}={root / agent}"]
    (root / "prices.csv").write_text("model,effective_from,input,cached,cache_write,output\nbig,2025-01-01,1,,,10\n")
    return root, given


def run(spark, args):
    out = io.StringIO()
    assert main(args, spark, out) == 0
    return out.getvalue()


@pytest.mark.parametrize("command", sorted(COMMANDS))
def test_commands(spark, logs, command):
    text = run(spark, [command, *(["s1"] if command == "timeline" else ["fix"]), *logs[1]])
    assert len(text.splitlines()) > 1


def test_forms(spark, logs):
    root, given = logs
    rows = [json.loads(x) for x in run(spark, ["cost", *given, "--prices", str(root / "prices.csv"), "--format", "json"]).splitlines()]
    total = next(r for r in rows if r["day"] is None)
    assert abs(total["usd"] - 310 / 1e6) < 1e-12 and total["calls"] == 4
    assert run(spark, ["tools", *given, "--format", "csv", "--agents", "claude"]).splitlines()[1].startswith("claude,Bash,1,1.0")
    assert "s1" in run(spark, ["find", "please fix", *given, "--mode", "all"])
    assert len(run(spark, ["sessions", *given, "--since", "2026-01-02", "--limit", "1"]).splitlines()) == 2
