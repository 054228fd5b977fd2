"""Rewritten logs are read anew and named, at every size."""

import os

from loomlog.sources import jsonl


def test_rewrites_of_every_size(spark, tmp_path):
    line = lambda c, n=1: b'{"a": "' + c * 90 + b'"}\n' * n
    big = b"".join(line(b"%d" % (i % 10)) for i in range(2500))
    assert len(big) > 3 * jsonl.CHECKED
    late = bytearray(big)
    late[len(big) - 1000 : len(big) - 997] = b"zzz"  # in the old tail, behind the first CHECKED bytes
    # name: before, after, whether its old rows go
    logs = {
        "same_size": (line(b"a"), line(b"b"), True),
        "small_grown": (line(b"a"), line(b"b") + line(b"c"), True),
        "small_appended": (line(b"a"), line(b"a") + line(b"c"), False),
        "big_late": (big, bytes(late) + line(b"c"), True),
        "big_appended": (big, big + line(b"c"), False),
        "no_line_left": (line(b"a"), b'{"', True),
        "touched": (line(b"a"), line(b"a"), False),
        "same": (line(b"a"), None, False),
    }
    for name, (old, _, _) in logs.items():
        (tmp_path / f"{name}.jsonl").write_bytes(old)
        os.utime(tmp_path / f"{name}.jsonl", (1_700_000_000, 1_700_000_000))
    state = spark.createDataFrame(jsonl.file_states(spark, str(tmp_path)).collect(), jsonl.STATE)
    for name, (_, new, _) in logs.items():
        if new is not None:
            (tmp_path / f"{name}.jsonl").write_bytes(new)
    got = jsonl.read_changes(spark, str(tmp_path), state).collect()
    name = lambda r: os.path.basename(r.path).removesuffix(".jsonl")
    assert {name(r) for r in got if r.rewritten} == {n for n, x in logs.items() if x[2]}
    lines = {}
    for r in jsonl.read_lines(spark, str(tmp_path), state).collect():
        lines[name(r)] = lines.get(name(r), 0) + 1
    assert lines == {"same_size": 1, "small_grown": 2, "small_appended": 1, "big_late": 2501, "big_appended": 1}
