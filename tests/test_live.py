"""The live fold: batch and stream agree on events in any order and any cut, over restarts; silence fires timers."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomlog.plans import live, run_views
from loomlog.streaming import live as stream

NOW = datetime(2024, 1, 20, 12)
SF = "/root/testdata/sf0.001"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, old)


def made(spark, rows):
    names = [c.split()[0] for c in live.EVENT.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], live.EVENT)


def states(df):
    names = [c.split()[0] for c in live.STATE.split(", ")]
    return sorted((tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.select(*names).collect()), key=str)


def judged(spark, runs):
    """Each run's figures; runs are lists of (minutes ago, event)."""
    events = made(spark, [{"loop_id": str(n), "at": NOW - timedelta(minutes=m), "seq": i, **e} for n, rows in enumerate(runs) for i, (m, e) in enumerate(rows)])
    found = {r.loop_id: r for r in live.judged(live.fold(events), F.lit(NOW).cast("timestamp")).collect()}
    return [found[str(n)] for n in range(len(runs))]


def test_phases(spark):
    lane = lambda agent, name="l": {"ev": "dispatch", "lane": name, "agent": agent}
    back, beat = {"ev": "return", "lane": "l"}, {"ev": "heartbeat"}
    cases = [
        ("preparing", [(5, {"ev": "open"})]),
        ("working", [(5, lane("builder")), (4, lane("reviewer", "m"))]),
        ("reviewing", [(5, lane("reviewer"))]),
        ("gating", [(5, lane("p:gate-runner-2")), (4, lane("builder", "m"))]),
        ("waiting", [(70, lane("builder"))]),
        ("landing", [(20, lane("builder")), (19, back), (5, {"ev": "land", "task": "t"})]),
        ("waiting", [(20, lane("builder")), (19, back), (18, {"ev": "land"})]),
        ("gating", [(70, lane("builder")), (69, {"ev": "watch", "op": "start", "what": "ci", "until": NOW + timedelta(hours=1)})]),
        ("waiting", [(70, lane("builder")), (69, {"ev": "watch", "op": "start", "what": "ci", "until": NOW - timedelta(hours=1)})]),
        ("closing", [(70, lane("builder")), (1, {"ev": "close"})]),
        (None, [(5, {"ev": "park", "task": "t"})]),
        ("working", [(30, lane("builder")), (29, back), (14, beat)]),
        ("waiting", [(30, lane("builder")), (29, back), (16, beat), (12, beat)]),  # the second comes too early to count
    ]
    assert [r.phase for r in judged(spark, [rows for _, rows in cases])] == [p for p, _ in cases]


def test_what_is_uncertain(spark):
    base = [(50, {"ev": "open"}), (40, {"ev": "dispatch", "lane": "l", "agent": "builder"}), (30, {"ev": "gate", "scope": "all", "exit_code": 0, "call": "c", "call_order": 2}), (20, {"ev": "admit", "task": "t"})]
    more = [
        [], [(10, {"ev": "uncertain"})], [(35, {"ev": "uncertain", "read_only": True})], [(30, {"ev": "uncertain", "for_ev": "gate", "call": "c", "call_order": 1})], [(30, {"ev": "uncertain", "for_ev": "gate", "call": "d", "call_order": 1})],
        [(5, {"ev": "uncertain", "for_ev": "admit", "task": "t"})], [(5, {"ev": "uncertain", "for_ev": "admit", "task": "u"})], [(5, {"ev": "dispatch"})], [(5, {"ev": "return"})],
    ]
    told, any_, earlier, same_call, other_call, known, other, nameless, back = judged(spark, [[*base, *m] for m in more])
    assert (told.active_lanes, told.gate_scope, told.tasks_admitted, told.parks) == (1, "all", 1, 0)
    assert (any_.phase, any_.active_lanes, any_.gate_scope, any_.tasks_admitted, any_.parks) == (None,) * 5
    assert (earlier.phase, earlier.active_lanes, earlier.gate_scope) == ("working", None, "all")  # a later gate is known again, totals aren't
    assert (same_call.gate_scope, other_call.gate_scope) == ("all", None)
    assert (known.tasks_admitted, other.tasks_admitted) == (1, None)
    assert (nameless.active_lanes, nameless.phase, back.phase) == (None, "working", None)


def test_awkward_rows(spark):
    events = made(spark, [{"loop_id": None, "at": NOW, "ev": "open"}, {"loop_id": "a", "at": None, "ev": "open"}, {"loop_id": "a", "at": NOW, "ev": None}])
    assert live.fold(events).collect() == []
    twice = made(spark, [{"loop_id": "a", "at": NOW, "seq": 1, "ev": "park"}] * 2 + [{"loop_id": "a", "at": NOW, "seq": 2, "ev": "what"}])
    assert live.fold(twice).first().parks == 1


def run_stream(spark, folder, batches, tmp):
    """Each batch is a file that a trigger reads; the query restarts from its checkpoint between them."""
    out = []
    for n, batch in enumerate(batches):
        batch.coalesce(1).write.mode("append").parquet(folder)
        source = spark.readStream.schema(live.EVENT).parquet(folder)
        got = []
        query = stream.run_states(source, "60 days").writeStream.outputMode("update").foreachBatch(lambda df, i: got.extend(r.asDict() for r in df.collect())).option("checkpointLocation", f"{tmp}/check").trigger(availableNow=True).start()  # noqa: B023
        assert query.awaitTermination(200)
        out += [r | {"batch": n} for r in got]
    return out


def test_stream_is_the_batch_fold(spark, rocks, tmp_path):
    events = run_views.run_events(lambda name: spark.read.parquet(f"{SF}/{name}.parquet"))
    rows = events.filter("loop_id IN ('u0', 'u3', 'u5')").collect()
    random.Random(4).shuffle(rows)
    rows += rows[:20]  # some come again
    cuts = [spark.createDataFrame(rows[a:b], live.EVENT) for a, b in ((0, 30), (30, 150), (150, len(rows)))]
    told = run_stream(spark, str(tmp_path / "in"), cuts, tmp_path)
    last = stream.latest(spark.createDataFrame(told, stream.OUTPUT + ", batch int"), "batch")
    assert states(last) == states(live.fold(events.filter("loop_id IN ('u0', 'u3', 'u5')")))


def test_silence_fires(spark, rocks, tmp_path):
    events = made(spark, [{"loop_id": "a", "at": NOW, "seq": 1, "ev": "dispatch", "lane": "l"}])
    later = made(spark, [{"loop_id": "b", "at": NOW + timedelta(days=70), "seq": 2, "ev": "open"}])
    last = made(spark, [{"loop_id": "b", "at": NOW + timedelta(days=140), "seq": 3, "ev": "park"}])
    told = run_stream(spark, str(tmp_path / "in"), [events, later, last], tmp_path)
    assert any(r["loop_id"] == "a" and r["fired"] and r["lanes"] == 1 for r in told)
