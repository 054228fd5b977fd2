"""Logs that are read split by split give the same lines as whole ones."""

import random

from loomlog.sources import jsonl


def test_splits(spark, tmp_path):
    r = random.Random(1)
    contents = {
        "plain": b"".join(b'{"n": %d, "x": "%s"}\n' % (i, b"y" * r.randrange(200)) for i in range(3000)),
        "odd": b"\n\r\n{}\r\n" + "é中\n".encode() + b"\xff\xfe bad\na\0b\n" + b"no end",
        "padded": b'{"a": 1}\n' + b"\0" * 300,
        "long": b'{"a": "' + b"z" * 70_000 + b'"}\n{}\n',
        "none": b"no line",
    }
    (tmp_path / "deep").mkdir()
    for name, content in contents.items():
        (tmp_path / "deep" / f"{name}.jsonl").write_bytes(content)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    want = sorted(tuple(x) for x in jsonl.read_changes(spark, str(tmp_path)).filter("byte_offset IS NOT NULL").drop("rewritten").collect())
    for limit in ("4096", "65536", size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
        try:
            got = jsonl.all_lines(spark, str(tmp_path))
            assert sorted(tuple(x) for x in got.collect()) == want
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert len(want) == 3000 + 6 + 1 + 2
