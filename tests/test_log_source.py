"""The log source: rows as Spark's own reader gives them, resumed reads, budgets, rewrites, restarts and unreadable files."""

import json
import os
import random

from loomlog.sources import jsonl, logs


def contents():
    r = random.Random(1)
    return {
        "plain": b"".join(b'{"n": %d, "x": "%s"}\n' % (i, b"y" * r.randrange(200)) for i in range(3000)),
        "odd": b"\n\r\n{}\r\n" + "é中\n".encode() + b"\xff\xfe bad\na\0b\n" + b"no end",
        "padded": b'{"a": 1}\n' + b"\0" * 300,
        "long": b'{"a": "' + b"z" * 70_000 + b'"}\n{}\n',
        "none": b"no line",
    }


def put(folder, files):
    folder.mkdir(parents=True, exist_ok=True)
    for name, content in files.items():
        (folder / f"{name}.jsonl").write_bytes(content)


LINE = ("path", "byte_offset", "byte_length", "line_no", "raw")


def rows(df, *columns):
    return sorted((tuple(x) for x in df.select(*(columns or LINE)).collect()), key=str)


def test_same_rows_as_sparks_reader_without_a_shuffle(spark, tmp_path, monkeypatch):
    put(tmp_path / "deep" / "er", contents())
    (tmp_path / "deep" / "link.jsonl").symlink_to(tmp_path / "deep" / "er" / "plain.jsonl")
    want = rows(jsonl.all_lines(spark, str(tmp_path / "deep" / "er")))
    for split, chunk in ((logs.SPLIT_BYTES, logs.CHUNK), (4_096, 1_000), (100_000, 70)):
        monkeypatch.setattr(logs, "CHUNK", chunk)
        got, state = logs.log_lines(spark, str(tmp_path / "deep"), split_bytes=split)
        assert rows(got) == want
        assert "Exchange" not in got._jdf.queryExecution().toString()
    again, same = logs.log_lines(spark, str(tmp_path), state)
    assert again.count() == 0 and same == state
    assert logs.log_lines(spark, str(tmp_path / "nowhere"))[0].count() == 0


def test_what_came_since(spark, tmp_path):
    line = lambda c, n=1: b'{"a": "' + c * 90 + b'"}\n' * n
    big = b"".join(line(b"%d" % (i % 10)) for i in range(2500))
    late = bytearray(big)
    late[len(big) - 1000 : len(big) - 997] = b"zzz"
    # name: before, after, whether its old rows go, lines of the second read
    files = {
        "same_size": (line(b"a"), line(b"b"), True, 1),
        "small_grown": (line(b"a"), line(b"b") + line(b"c"), True, 2),
        "small_appended": (line(b"a") + b"half", line(b"a") + b"half of it\n", False, 1),
        "big_late": (big, bytes(late) + line(b"c"), True, 2501),
        "big_appended": (big, big + line(b"c"), False, 1),
        "no_line_left": (line(b"a"), b'{"', True, 0),
        "touched": (line(b"a"), line(b"a"), False, 0),
        "same": (line(b"a"), None, False, 0),
    }
    put(tmp_path, {n: f[0] for n, f in files.items()})
    for n in files:
        os.utime(tmp_path / f"{n}.jsonl", (1_700_000_000, 1_700_000_000))
    _, state = logs.log_lines(spark, str(tmp_path))
    state = json.loads(json.dumps(state))
    put(tmp_path, {n: f[1] for n, f in files.items() if f[1] is not None})
    put(tmp_path, {"new": line(b"n")})
    found, _ = logs.log_lines(spark, str(tmp_path), state, split_bytes=50_000)
    name = lambda path: os.path.basename(path).removesuffix(".jsonl")
    assert {name(r.path) for r in logs.stale_paths(found).collect()} == {n for n, f in files.items() if f[2]}
    counts = {}
    for r in found.filter("byte_offset IS NOT NULL").collect():
        counts[name(r.path)] = counts.get(name(r.path), 0) + 1
    assert counts == {n: f[3] for n, f in files.items() if f[3]} | {"new": 1}
    appended = found.filter("path LIKE '%big_appended%' OR path LIKE '%small_appended%'").collect()
    assert sorted((name(r.path), r.byte_offset) for r in appended) == [("big_appended", len(big)), ("small_appended", len(line(b"a")))]


def test_files_that_cannot_be_read(spark, tmp_path, monkeypatch):
    put(tmp_path, {"good": b"{}\n", "bad": b"{}\n"})
    opened = logs._opened
    monkeypatch.setattr(logs, "_opened", lambda p: (_ for _ in ()).throw(PermissionError("no")) if "bad" in p else opened(p))
    found, state = logs.log_lines(spark, str(tmp_path))
    assert [tuple(r) for r in logs.load_errors(found).collect()] == [(f"file:{tmp_path}/bad.jsonl", "load_error", "PermissionError: no")]
    assert found.filter("error IS NULL").count() == 1
    assert logs.log_lines(spark, str(tmp_path), state)[0].count() == 0  # told once
    monkeypatch.setattr(logs, "_opened", opened)
    put(tmp_path, {"bad": b"{}\n{}\n", "gone": b"{}\n"})
    late, _ = logs.log_lines(spark, str(tmp_path), state)
    os.unlink(tmp_path / "gone.jsonl")  # between planning and reading
    got = late.collect()
    assert sorted((os.path.basename(r.path), (r.error or "")[:17]) for r in got) == [("bad.jsonl", ""), ("bad.jsonl", ""), ("gone.jsonl", "FileNotFoundError")]


def test_budget_serves_every_file_in_turn(tmp_path):
    put(tmp_path, {n: b"x" * 49 + b"\n" for n in "abc"} | {"d": b"y" * 500 + b"\n"})
    known, seen = {}, []
    for _ in range(8):
        put(tmp_path, {"a": (tmp_path / "a.jsonl").read_bytes() + b"x" * 49 + b"\n"})  # always has something new
        new = logs.advanced(logs.listed(str(tmp_path)), known, 60)
        seen.append([os.path.basename(p.path)[0] for p in logs.pieces(known, new)])
        known = new
    assert {n for s in seen[:4] for n in s} == set("abcd")  # a line longer than the budget comes whole
    assert sum(p.limit - p.start for p in logs.pieces({}, known)) == sum(e["offset"] for e in known.values())


def test_stream_with_a_restart(spark, tmp_path):
    spark.dataSource.register(logs.LogSource)
    root, out, check = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "check")
    files = {n: c for n, c in contents().items() if n != "none"}
    halves = {n: c[: len(c) // 2] for n, c in files.items()}

    def run():
        stream = spark.readStream.format("agentlogs").option("path", str(root)).option("trigger_bytes", 60_000).option("split_bytes", 20_000).load()
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).start()
        try:
            query.processAllAvailable()
            return len([p for p in query.recentProgress if p["numInputRows"]])
        finally:
            query.stop()

    put(root, halves)
    assert run() > 1  # several triggers
    put(root, files)
    run()
    put(root, {"odd": b"all new\n"})
    run()
    got = spark.read.parquet(out)
    first = rows(got.filter("NOT rewritten"), "path", "byte_offset", "byte_length", "raw")
    put(root, {"odd": files["odd"]})
    assert first == rows(jsonl.all_lines(spark, str(root)), "path", "byte_offset", "byte_length", "raw")
    assert rows(got.filter("rewritten"), "byte_offset", "raw") == [(0, "all new")]
