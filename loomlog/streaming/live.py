"""The state of runs (loomlog.plans.live) kept by a stream: events in any order, several state variables a run, timers for silence.

Each micro-batch gives a run's new STATE row when it has changed, and once more when the watermark passes the times at which silence
alone changes its phase, so that a table of the latest rows, judged, follows the runs. A run that is closed and silent for KEPT is
forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomlog.plans import live

#: Microseconds: of a minute, and after which a closed run is forgotten.
MINUTE, KEPT = 60_000_000, 30 * 86_400_000_000
OUTPUT = live.STATE + ", fired boolean"

_FACTS = "opened boolean, closed boolean, active_at long, dispatched_at long, landed_at long, parks long, timer long"
_SNAP = "at long, seq long, call string, call_order int, text string, number int"


def _when(micros: int | None) -> datetime | None:
    return None if micros is None else datetime.fromtimestamp(micros / 1_000_000, timezone.utc).replace(tzinfo=None)


def _later(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else max(a, b)


class RunStates(StatefulProcessor):
    """State variables: facts (one row), snaps (the last park, gate and note), lanes and watches (the last word on each), tasks, beats
    (heartbeats from the last one on that the watermark has made final), doubts, and seen (events later than the watermark, by number)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.facts = handle.getValueState("facts", _FACTS)
        self.snaps = handle.getMapState("snaps", "kind string", _SNAP)
        self.lanes = handle.getMapState("lanes", "key string", "at long, seq long, live boolean, role string")
        self.watches = handle.getMapState("watches", "what string", "at long, seq long, on boolean, until long")
        self.tasks = handle.getMapState("tasks", "ev string, task string", "n int")
        self.beats = handle.getMapState("beats", "at long", "n int")
        self.doubts = handle.getMapState("doubts", "at long, for_ev string, task string, observed boolean, read_only boolean, call string, call_order int", "n int")
        self.seen = handle.getMapState("seen", "at long, seq long, ev string", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        opened, closed, active, dispatched, landed, parks, timer = self.facts.get() if self.facts.exists() else (False, False, None, None, None, 0, None)
        watermark = timerValues.getCurrentWatermarkInMs() * 1_000
        for frame in rows:
            frame = frame.astype({c: "Int64" for c in ("at_", "seq", "until_", "exit_code", "call_order")}).astype(object)
            for e in frame.where(frame.notna(), None).itertuples(index=False):
                mark = (e.at_, e.seq, e.ev)
                if self.seen.containsKey(mark):
                    continue
                self.seen.updateValue(mark, (1,))
                if e.doubt:
                    self.doubts.updateValue((e.at_, e.doubt_for, e.doubt_task, bool(e.observed), bool(e.read_only), e.call, e.call_order), (1,))
                if e.ev == "heartbeat":
                    self.beats.updateValue((e.at_,), (1,))
                elif e.ev != "uncertain":
                    active = _later(active, e.at_)
                if e.ev in ("open", "close"):
                    opened, closed = opened or e.ev == "open", closed or e.ev == "close"
                elif e.ev in ("dispatch", "return"):
                    dispatched = _later(dispatched, e.at_) if e.ev == "dispatch" else dispatched
                    if e.key is not None:
                        self._last(self.lanes, (e.key,), e, (e.ev == "dispatch", e.role))
                elif e.ev == "watch" and e.what is not None and e.op in ("start", "stop"):
                    self._last(self.watches, (e.what,), e, (e.op == "start", e.at_ if e.until_ is None else e.until_))
                elif e.ev == "park":
                    parks += 1
                    self._last(self.snaps, ("park",), e, (e.call, e.call_order, e.task, None))
                elif e.ev == "gate":
                    self._last(self.snaps, ("gate",), e, (e.call, e.call_order, e.scope, e.exit_code))
                elif e.ev == "judgement" and e.text is not None:
                    self._last(self.snaps, ("note",), e, (e.call, e.call_order, e.text[:500], None))
                if e.ev == "land":
                    landed = _later(landed, e.at_)
                if e.ev in ("admit", "land") and e.task:
                    self.tasks.updateValue((e.ev, e.task), (1,))
        # what the watermark has passed can't come again: its numbers go, and so do heartbeats before the last final one
        for mark in [m for m in self.seen.keys() if m[0] < watermark]:
            self.seen.removeKey(mark)
        beats = sorted(b[0] for b in self.beats.keys())
        beat, final = None, None
        for b in beats:
            if beat is None or b - beat >= live.BEAT * 1_000_000:
                beat = b
                final = b if b < watermark else final
        for b in beats:
            if final is not None and b < final:
                self.beats.removeKey((b,))
        last = _later(active, beat)
        if last is not None and timer != (due := last + live.QUIET * MINUTE):
            for old in [] if timer is None else [timer + x * MINUTE for x in (0, live.STALE - live.QUIET)]:
                self.handle.deleteTimer(old // 1_000)
            for at in (due, due + (live.STALE - live.QUIET) * MINUTE):
                self.handle.registerTimer(at // 1_000)
            timer = due
        self.facts.update((opened, closed, active, dispatched, landed, parks, timer))
        yield self._row(key, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        facts = self.facts.get()
        now = expiredTimerInfo.getExpiryTimeInMs() * 1_000
        last = _later(facts[2], max((b[0] for b in self.beats.keys()), default=None))
        if facts[1] and last is not None and now >= last + KEPT:
            for state in (self.facts, self.snaps, self.lanes, self.watches, self.tasks, self.beats, self.doubts, self.seen):
                state.clear()
            return
        if facts[1]:
            self.handle.registerTimer((last + KEPT) // 1_000 + 1)
        yield self._row(key, True)

    @staticmethod
    def _last(state, key: tuple, e, value: tuple) -> None:
        """Sets a key's value if the event is not before the one that it comes from."""
        old = state.getValue(key) if state.containsKey(key) else None
        if old is None or (old[0], old[1]) <= (e.at_, e.seq):
            state.updateValue(key, (e.at_, e.seq, *value))

    def _row(self, key, fired: bool) -> pd.DataFrame:
        opened, closed, active, dispatched, landed, parks, _ = self.facts.get()
        beat = None
        for b in sorted(b[0] for b in self.beats.keys()):
            beat = b if beat is None or b - beat >= live.BEAT * 1_000_000 else beat
        snaps = {k[0]: v for k, v in self.snaps.iterator()}
        lanes = [v for _, v in self.lanes.iterator() if v[2]]
        watches = [v[3] for _, v in self.watches.iterator() if v[2]]
        tasks = {tuple(t) for t in self.tasks.keys()}
        park, gate, note = (snaps.get(n, (None,) * 6) for n in ("park", "gate", "note"))
        row = (
            key[0], opened, closed, _when(active), _when(beat), _when(dispatched), _when(landed), len(lanes), sorted({v[3] for v in lanes}), _when(max(watches, default=None)), parks, park[4], gate[4], gate[5], note[4],
            sum(t[0] == "admit" for t in tasks), sum(t[0] == "land" for t in tasks), self._unknown(snaps, tasks), fired,
        )
        names = [c.split()[0] for c in OUTPUT.split(", ")]
        return pd.DataFrame([row], columns=names).astype({"gate_exit": "Int32"})

    def _unknown(self, snaps: dict, tasks: set) -> list[str]:
        out = set()
        for at, kind, task, observed, read_only, call, order in self.doubts.keys():
            of = lambda *kinds: kind is None or kind in kinds  # noqa: E731, B023

            def after(name: str, at=at, call=call, order=order) -> bool:
                snap = snaps.get(name)
                if snap is None or at != snap[0]:
                    return snap is None or at > snap[0]
                return not (call is not None and call == snap[2] and (order or 0) < (snap[3] or 0))

            out |= {"lanes"} if of("dispatch", "return") else set()
            out |= {"parks"} if of("park") else set()
            out |= {name for name, ev in (("park", "park"), ("gate", "gate"), ("note", "judgement")) if of(ev) and after(name)}
            out |= {name for name, ev in (("admitted", "admit"), ("landed", "land")) if of(ev) and (task is None or (ev, task) not in tasks)}
            if (kind in ("dispatch", "return", "close", "watch") and not observed) or (kind is None and not read_only):
                out.add("phase")
        return sorted(out)


def run_states(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """STATE rows of a stream of events (live.EVENT), in update mode; fired marks those that silence alone has caused.

    The session needs RocksDB as its state store. Events later than the watermark are left out.
    """
    key = live.lane_key(F.col("run"), F.col("lane"))
    nameless = F.col("ev").isin("dispatch", "return") & key.isNull()
    seen = F.coalesce("observed", F.lit(False)) | (nameless & (F.col("ev") == "dispatch"))
    given = events.filter("loop_id IS NOT NULL AND at IS NOT NULL AND ev IS NOT NULL").withWatermark("at", late).select(
        "loop_id", "at", F.unix_micros("at").alias("at_"), "seq", "ev", key.alias("key"), live.role(F.col("agent")).alias("role"), "task", "scope", "exit_code", "text", "what", "op", F.unix_micros("until").alias("until_"),
        "call", "call_order", ((F.col("ev") == "uncertain") | nameless).alias("doubt"), F.when(nameless, F.col("ev")).otherwise(F.col("for_ev")).alias("doubt_for"), F.when(~nameless, F.nullif("task", F.lit(""))).alias("doubt_task"), seen.alias("observed"), F.coalesce("read_only", F.lit(False)).alias("read_only"),
    )
    return given.groupBy("loop_id").transformWithStateInPandas(RunStates(), OUTPUT, "Update", "EventTime")


def latest(rows: DataFrame, order: str) -> DataFrame:
    """The last STATE row of each run, by the number of the micro-batch that gave it; a row of events before one of silence."""
    return rows.groupBy("loop_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("loop_id", order)]), F.struct(F.col(order), F.col("fired"))).alias("s")).select("loop_id", "s.*").drop("fired")
