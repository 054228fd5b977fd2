"""Metric families and orchestration runs."""

import datetime as dt
import random
import time

from pyspark.sql import functions as F

from loomlog.plans import loops, metrics


def test_exposition_round_trip(spark):
    df = spark.createDataFrame([("a", 3.0, 1), ('b"\n', 30.0, 2), ("a", 70.0, 3)], "k string, v double, n int")
    fam = metrics.family(df.groupBy("k").agg(F.sum("v").alias("s")), "x_total", "counter", "Sum.", F.col("s"), k=F.col("k")).unionByName(metrics.histogram(df, "h", "Values.", F.col("v"), [5, 50], k=F.col("k")))
    lines = metrics.exposition(fam)
    text = [r.line for r in lines.orderBy("family", "rank", "line").collect()]
    assert "# TYPE h histogram" in text and 'h_bucket{k="a",le="+Inf"} 2' in text and 'x_total{k="a"} 73' in text
    assert metrics.differences(fam.select("name", "labels", "value"), metrics.parse_exposition(lines)).count() == 0
    mapped = {(r.name, r.labels.get("le")): r.value for r in metrics.remapped(fam, "k", {"a": "z"}, "z").collect()}
    assert mapped["x_total", None] == 103 and mapped["h_bucket", "5"] == 1 and mapped["h_count", None] == 3
    assert sorted(r.k for r in metrics.capped(df, "k", "n", "n", 1).collect()) == ["a", "a", "other"]


def test_counter_increase(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 9.0), (3, 2.0)], "at int, value double").select("*", F.lit("c").alias("name"), F.lit("counter").alias("type"), F.create_map(F.lit("l"), F.lit("x")).alias("labels"))
    assert metrics.counter_increase(df, "at").first().increase == 11


def test_loops(spark):
    t = lambda h: dt.datetime(2026, 1, 1, h)
    launched = spark.createDataFrame([(1, "s", t(0)), (2, "s", t(5)), (3, "u", t(1)), (4, "v", t(2)), (5, "v", t(2)), (6, "w", t(3))], "loop_id int, session_uid string, launched_at timestamp")
    w = loops.windows(launched)
    got = {r.loop_id: r for r in w.collect()}
    assert got[1].cutoff == t(5) and got[2].cutoff is None and got[4].tied and not got[3].tied
    receipts = spark.createDataFrame([("s", t(6), "ok"), ("s", t(7), "late"), ("v", t(3), "ok")], "session_uid string, received_at timestamp, verdict string")
    done = loops.receipts_in_window(w, receipts)
    assert [(r.loop_id, r.verdict) for r in done.collect()] == [(2, "ok")]
    waits = spark.createDataFrame([(3, t(2), t(20), "wait"), (6, t(4), None, "pause")], "loop_id int, at timestamp, until timestamp, kind string")
    last = spark.createDataFrame([("u", t(2))], "session_uid string, last_ts timestamp")
    state = {r.loop_id: r.state for r in loops.lifecycle(w, done, waits, last, "2026-01-01 10:00:00", 6).collect()}
    assert (state[1], state[2], state[3], state[5], state[6]) == ("finished", "finished", "waiting", "stale", "paused")
    calls = spark.createDataFrame([("s", t(1), 1, 2), ("s", t(6), 5, None), ("lane", t(9), 7, 8)], "session_uid string, ts timestamp, input_tokens int, output_tokens int")
    lanes = spark.createDataFrame([(1, "lane")], "loop_id int, session_uid string")
    p = {r.loop_id: (r.calls, r.input_tokens, r.output_tokens) for r in loops.progress(w, lanes, calls).collect()}
    assert p == {1: (2, 8, 10), 2: (1, 5, None)}
    tree = spark.createDataFrame([("a", False, False, True, False), ("a", True, False, False, False), ("b", False, False, False, False)], "root string, launched boolean, workflow boolean, spawned boolean, lane boolean")
    assert {r.root: r.kind for r in loops.orchestration_kind(tree).collect()} == {"a": "loop", "b": "solo"}


def test_tasks_done_against_a_plain_count(spark):
    """Windows that overlap, are empty, have no end or no begin; times that are equal; repositories never scanned."""
    r = random.Random(5)
    at = lambda n: dt.datetime(2026, 1, 1) + dt.timedelta(seconds=n)
    launched = [(i, r.choice(["a", "b", "c", "d", None]), at(r.randrange(60)), r.choice([None, at(r.randrange(70))])) for i in range(200)] + [(900, "a", None, None), (901, "a", at(5), at(5))]
    done = [(r.choice(["a", "b", "c", None]), r.choice([None, *(f"T-{i}" for i in range(9))]), r.choice([None, *(at(r.randrange(70)) for _ in range(9))])) for _ in range(300)]
    given = spark.createDataFrame(launched, "loop_id int, repo string, launched_at timestamp, cutoff timestamp"), spark.createDataFrame(done, "repo string, task_key string, done_at timestamp"), spark.createDataFrame([("a",), ("b",), ("b",), ("d",)], "repo string")
    found = loops.tasks_done(*given)
    want = {}
    for id, repo, begin, end in launched:
        want[id] = len({t for p, t, x in done if p == repo and t and x and begin and x >= begin and (end is None or x < end)}) if repo in ("a", "b", "d") else None
    assert {x.loop_id: x.tasks_done for x in found.collect()} == want and max(n or 0 for n in want.values()) == 9
    # many windows over many times: as many rows as go in times their bits, not pairs
    span = spark.range(8000).select("id", F.concat(F.lit("r"), F.col("id") % 1).alias("repo"), F.timestamp_seconds("id").alias("launched_at"), F.timestamp_seconds(F.col("id") + 4000).alias("cutoff")).withColumnRenamed("id", "loop_id")
    told = spark.range(8000).select(F.concat(F.lit("r"), F.col("id") % 1).alias("repo"), (F.col("id") % 5000).cast("string").alias("task_key"), F.timestamp_seconds("id").alias("done_at"))
    began = time.time()
    assert loops.tasks_done(span, told, told.select("repo")).agg(F.sum("tasks_done")).first()[0] == sum(min(4000, 8000 - i) for i in range(8000))
    assert time.time() - began < 60
