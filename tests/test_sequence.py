"""Sequence numbers across micro-batches, and windows over streams."""

from loomlog.streaming import refresh, sequence

SCHEMA = "session_uid string, position long, event_uid string"


def drain(spark, stream, sink, mode="append", checkpoint=None):
    q = stream.writeStream.format("memory").queryName(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(200)
    assert q.exception() is None


def test_numbers_go_on_and_late_rows_show(spark, tmp_path):
    source, got = str(tmp_path / "in"), {}
    for i, rows in enumerate([[("a", 5, "x"), ("a", 1, "y"), ("b", 1, "z")], [("a", 9, "w"), ("a", 2, "v")]]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        out = str(tmp_path / "out")
        q = sequence.sequenced(spark.readStream.schema(SCHEMA).parquet(source)).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(200)
        assert q.exception() is None
        got = {r.event_uid: (r.seq, r.late) for r in spark.read.parquet(out).collect()}
    assert got == {"y": (1, False), "x": (2, False), "z": (1, False), "w": (3, False), "v": (None, True)}
    events = spark.read.parquet(source)
    late = spark.read.parquet(str(tmp_path / "out")).filter("late")
    assert {r.event_uid: r.seq for r in sequence.renumbered(events, late).collect()} == {"y": 1, "v": 2, "x": 3, "w": 4}


def test_hours(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2026-01-01 00:10:00' AS ts, 'a' AS k UNION ALL SELECT timestamp'2026-01-01 00:50:00', 'a' UNION ALL SELECT timestamp'2026-01-01 05:00:00', 'a'")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    drain(spark, refresh.hourly_counts(stream, "ts", ["k"]), "hours", "complete", str(tmp_path / "c1"))
    assert sorted(r.n for r in spark.table("hours").collect()) == [1, 2]
    drain(spark, refresh.active_lanes(stream, "ts", "k"), "lanes", "append", str(tmp_path / "c2"))
    assert [r.n for r in spark.table("lanes").collect()] == [1, 1]
