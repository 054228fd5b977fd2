"""Counters of what agents spend their time and calls on, from the events of loomlog.sources.activity, kept by a stream.

A thread (one log file) is a key. Its state is a row of facts and three maps: calls without a result, running processes, ids that were
counted. A micro-batch gives increments (metric, labels, amount, time), so that totals are a sum, and a loop's label can be joined to
them by time; reading logs in any number of parts gives the same as at once. Ids are forgotten after a month; a worker's lane that has
been silent for GAP is closed by a timer of the watermark.

Time between two records of a thread goes to what it was in: idle, the last open tool call's class, or the model; half an hour or more
in the model is a gap. A model call's trigger is what came before it: a prompt, a tool's class, a wait that ran out (wait) or delivered
(event), another agent's message, or the model itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomlog.sources import activity

# The counters with their labels (agent and namespace come first), and the histograms with their bounds.
COUNTERS = {
    "agent_efficiency_time_seconds_total": ("role", "state"),
    "agent_efficiency_llm_calls_total": ("role", "trigger"),
    "agent_efficiency_input_tokens_total": ("role", "trigger", "cache"),
    "agent_efficiency_output_tokens_total": ("role",),
    "agent_efficiency_model_seconds_total": ("role", "model"),
    "agent_efficiency_model_calls_total": ("role", "model"),
    "agent_efficiency_tool_calls_total": ("role", "class"),
    "agent_efficiency_poll_calls_total": ("role", "target", "result"),
    "agent_efficiency_poll_seconds_total": ("role", "target", "result"),
    "agent_efficiency_wait_timeout_ms_total": ("role", "tool"),
    "agent_efficiency_wait_requests_total": ("role", "tool"),
    "agent_efficiency_spawns_total": (),
    "agent_efficiency_compactions_total": ("role",),
    "agent_efficiency_turn_errors_total": ("kind",),
    "agent_efficiency_spawns_by_route_total": ("role", "spawn_model", "effort", "agent_type", "fork"),
    "agent_efficiency_spawn_errors_total": ("kind",),
    "agent_efficiency_git_pushes_total": ("role", "outcome"),
    "agent_efficiency_ci_waits_total": ("role", "outcome"),
    "agent_efficiency_gate_runs_total": ("role", "outcome"),
    "agent_efficiency_coderabbit_findings_total": ("role", "severity"),
    "agent_efficiency_coderabbit_reviews_total": ("role", "outcome"),
    "agent_efficiency_tool_failures_total": ("role", "class"),
    "agent_efficiency_interventions_total": ("role", "kind"),
    "agent_efficiency_root_llm_calls_by_protocol_total": ("protocol", "poll"),
    "agent_efficiency_root_time_seconds_by_protocol_total": ("protocol", "state"),
}
HISTOGRAMS = {"agent_efficiency_lane_seconds": (300, 900, 1800, 3600, 7200, 14400), "agent_efficiency_first_spawn_seconds": (60, 300, 900, 1800, 3600)}
#: Microseconds of silence that close a worker's lane and make a gap of the model's time.
SECOND, GAP = 1_000_000, 1800 * 1_000_000
#: How long ids are remembered, and running processes of a thread at most (the oldest go: their outcome is then never told).
REMEMBERED_MS, MOST_PROCESSES = 30 * 86_400_000, 256

OUTPUT = "agent string, thread string, uid string, at long, metric string, labels array<string>, amount double"
_FACTS = (
    "role string, in_task boolean, trig string, model string, last long, start long, lane long, spoken boolean, called boolean, proto string, source string, marked boolean, first boolean, uid string, parent string, turn int, records boolean, total string, "
    "spawned boolean, launched long, h_at long, h_role string, h_trig string, h_model string, h_total long, h_hit long, h_out long, h_turn int"
)
_NAMES = [f.strip().split()[0] for f in _FACTS.split(", ")]
_PENDING = "at long, tool_class string, target string, rule string, delivery string, background boolean, route string, spawns int, start string, turn int"
_PROCESS = "target string, delivery string, marks string"


class Thread:
    """The fold of one thread's events: facts f, open calls, processes and ids (dicts that the caller loads and stores)."""

    def __init__(self, agent: str, facts: dict | None, pending: dict, processes: dict, ids: dict):
        self.agent, self.pending, self.processes, self.ids = agent, pending, processes, ids
        fresh = dict.fromkeys(_NAMES) | {"role": "solo", "in_task": True, "trig": "user", "spoken": False, "called": False, "marked": False, "first": False, "turn": 0, "records": False, "spawned": False}
        self.f, self.out, self.at = facts or fresh, [], None

    def add(self, metric: str, amount: float, *labels: str) -> None:
        if self.at is not None:
            self.out.append((self.at, f"agent_efficiency_{metric}", list(labels), float(amount)))

    def step(self, e) -> None:
        self.at = e.at if e.at is not None else self.f["last"]
        getattr(self, f"on_{e.kind}")(e)

    def on_meta(self, e) -> None:
        if self.f["uid"] is None:
            self.f |= {"uid": e.uid, "parent": e.parent} | ({"role": "worker"} if e.flag else {})

    def on_tick(self, e) -> None:
        f, at = self.f, e.at
        if at is None:
            return
        last, worker = f["last"], f["role"] == "worker"
        f["start"] = at if f["start"] is None else f["start"]
        if worker and (f["lane"] is None or (last is not None and at - last > GAP)):
            self.close(f["lane"], last)
            f["lane"] = at
        if last is not None and at > last:
            state = "idle" if not f["in_task"] else f"tool_{list(self.pending.values())[-1]['tool_class']}" if self.pending else "model" if at - last <= GAP else "gap"
            seconds = (at - last) / SECOND
            self.add("time_seconds_total", seconds, f["role"], state)
            if not worker:
                self.add("root_time_seconds_by_protocol_total", seconds, f["proto"] or "none", state)
            if state == "model":
                self.add("model_seconds_total", seconds, f["role"], f["model"] or "unknown")
        f["last"] = at if last is None else max(at, last)

    def close(self, lane: int | None, last: int | None) -> None:
        if lane is not None and last is not None and last >= lane:
            self.out.append((last, "agent_efficiency_lane_seconds", [], (last - lane) / SECOND))

    def on_model(self, e) -> None:
        self.f["model"] = e.model

    def on_compact(self, e) -> None:
        """A compaction that leaves a boundary and then a summary is one."""
        again = e.rule == "summary" and self.f["marked"]
        self.f["marked"] = e.rule == "boundary"
        if not again:
            self.add("compactions_total", 1, self.f["role"])

    def on_start(self, e) -> None:
        self.flush()
        self.f |= {"turn": self.f["turn"] + 1, "in_task": True}

    def on_end(self, e) -> None:
        self.flush()
        self.pending.clear()
        self.f["in_task"] = False
        self.on_error(e)

    def on_error(self, e) -> None:
        if e.error is not None:
            self.add("turn_errors_total", 1, e.error)
        if e.flag:
            self.intervention("interrupt")

    def on_rest(self, e) -> None:
        self.f["in_task"] = self.f["in_task"] and bool(self.pending)

    def intervention(self, kind: str) -> None:
        if self.f["role"] != "worker":
            self.add("interventions_total", 1, self.f["role"], kind)

    def on_human(self, e) -> None:
        """A message that is written both as an event and as an item (rule) counts once. Workers' items aren't their owner's."""
        f = self.f
        if f["role"] == "worker" and (e.rule == "item" or self.agent == "pi"):
            return
        if e.rule is not None and f["source"] not in (None, e.rule):
            f["source"] = None
        else:
            if f["proto"] is None and f["role"] != "worker":
                f["proto"] = e.text
            if f["spoken"] or f["called"]:
                self.intervention("user_message")
            f |= {"spoken": True, "source": e.rule}
        if e.rule is not None:
            f |= {"in_task": True, "trig": "user"}

    def on_user(self, e) -> None:
        self.f["in_task"] = True

    def on_asked(self, e) -> None:
        """A user record without results: blocks set the trigger only once, plain text each time."""
        if not (e.flag and self.f["first"]):
            self.f["trig"] = e.text
        self.f["first"] = True

    def on_trigger(self, e) -> None:
        self.f["trig"] = e.text
        self.f["in_task"] = self.f["in_task"] or bool(e.flag)

    def on_agent(self, e) -> None:
        self.ids[f"agent:{e.id}"] = True

    def flush(self) -> None:
        f = self.f
        if f["h_turn"] is not None:
            at, self.at = self.at, f["h_at"]
            self.call(f["h_role"], f["h_trig"], f["h_model"], f["h_total"], f["h_hit"], f["h_out"])
            self.at, f["h_turn"] = at, None

    def on_count(self, e) -> None:
        """A running total stands for a call until its turn shows a usage record."""
        f = self.f
        if f["records"] or e.uid == f["total"]:
            return
        f["total"] = e.uid
        if e.flag:
            self.flush()
            f |= {"h_at": self.at, "h_role": f["role"], "h_trig": f["trig"], "h_model": f["model"], "h_total": e.total, "h_hit": e.hit, "h_out": e.output, "h_turn": f["turn"]}
            f |= {"called": True, "source": None, "trig": "model"}

    def on_usage(self, e) -> None:
        f = self.f
        if e.id is not None:
            if f"call:{e.id}" in self.ids:
                return
            self.ids[f"call:{e.id}"] = True
        elif self.agent == "codex":
            f["records"] = True
            if f["h_turn"] == f["turn"]:
                f["trig"] = f["h_trig"] if f["trig"] == "model" else f["trig"]
                f["h_turn"] = None
            self.flush()
        if e.flag:
            self.call(f["role"], f["trig"], f["model"], e.total, e.hit, e.output)
            f |= {"called": True, "source": None, "trig": "model"}

    def call(self, role: str, trig: str, model: str | None, total: int, hit: int, output: int) -> None:
        self.add("llm_calls_total", 1, role, trig)
        if role != "worker":
            self.add("root_llm_calls_by_protocol_total", 1, self.f["proto"] or "none", "true" if trig == "wait" else "false")
        self.add("input_tokens_total", hit, role, trig, "hit")
        self.add("input_tokens_total", max(0, total - hit), role, trig, "miss")
        self.add("output_tokens_total", output, role)
        self.add("model_calls_total", 1, role, model or "unknown")

    def on_tool(self, e) -> None:
        f, target = self.f, e.target
        if e.spawns == -1:
            self.spawn()
        if e.spawns == -2 and f["launched"] is None:
            f["launched"] = self.at
        self.add("tool_calls_total", 1, f["role"], e.cls)
        if e.cls == "wait" and e.wait_tool is not None and e.wait_ms is not None and e.wait_ms >= 0:
            self.add("wait_requests_total", 1, f["role"], e.wait_tool)
            self.add("wait_timeout_ms_total", e.wait_ms, f["role"], e.wait_tool)
        if target.startswith("@"):  # a poll of a process, which was started for something
            delivered = self.processes.get(target[1:], {})
            kinds, target = ([target] if delivered.get("delivery") else []), delivered.get("target") or "other"
        else:
            kinds = list(e.delivery if e.delivery is not None else [])
            target = ("agent" if f"agent:{target[1:]}" in self.ids else "other") if target.startswith("#") else target
        f["source"] = None
        route = "\t".join(e.route) if e.route is not None else None
        self.pending.pop(e.id, None)
        self.pending[e.id] = {"at": self.at, "tool_class": e.cls, "target": target, "rule": e.rule, "delivery": "+".join(kinds), "background": bool(e.background), "route": route, "spawns": e.spawns or 0, "start": e.text, "turn": len(self.pending)}

    def on_result(self, e) -> None:
        f, call = self.f, self.pending.pop(e.id, None)
        if call is None:
            return
        if call["tool_class"] != "wait":
            f["trig"] = call["tool_class"]
        else:
            came = call["rule"] != "sleep" and call["rule"] in list(e.events)
            f["trig"], result = ("event", "event") if came else ("wait", "timed_out")
            self.add("poll_calls_total", 1, f["role"], call["target"], result)
            if self.at is not None and call["at"] is not None and self.at > call["at"]:
                self.add("poll_seconds_total", (self.at - call["at"]) / SECOND, f["role"], call["target"], result)
        marks = e.marks or ""
        if e.flag or (call["rule"] == "patch" and "p" in marks):
            self.add("tool_failures_total", 1, f["role"], call["tool_class"])
        if e.running is not None and call["start"] is not None:
            self.processes.pop(e.running, None)
            self.processes[e.running] = {"target": call["start"], "delivery": None, "marks": ""}
            while len(self.processes) > MOST_PROCESSES:
                self.processes.pop(next(iter(self.processes)))
        self.spawned(e, call, marks)
        if call["delivery"]:
            self.delivered(e, call, marks)

    def spawned(self, e, call: dict, marks: str) -> None:
        if call["spawns"] > 0 and "n" not in marks:  # a cell with call sites
            for _ in range(call["spawns"]):
                self.spawn()
            if call["spawns"] == 1 and e.error is not None and e.error != "other":
                self.add("spawn_errors_total", 1, e.error)
        elif call["spawns"] == -1 and self.agent == "codex" and e.error is not None:
            self.add("spawn_errors_total", 1, e.error)
        elif call["spawns"] == -1 and not e.flag:
            self.add("spawns_by_route_total", 1, self.f["role"], *(call["route"] or "inherit\tinherit\tdefault\tnone").split("\t"))
        elif call["spawns"] == -2:
            for _ in range((e.spawns or 0) + bool(e.flag)):
                self.add("spawn_errors_total", 1, "other")
            children = list(e.route) if e.route is not None else []
            if children or e.uid is not None:
                self.begun(self.f["launched"])
            else:
                self.f["launched"] = None
            for child in children:
                self.add("spawns_total", 1)
                self.add("spawns_by_route_total", 1, self.f["role"], "inherit", "inherit", child, "none")

    def spawn(self) -> None:
        self.begun(self.at)
        self.add("spawns_total", 1)

    def begun(self, at: int | None) -> None:
        """The first spawn makes a thread a root and is timed from the thread's start."""
        f = self.f
        if not f["spawned"] and f["role"] != "worker" and at is not None and f["start"] is not None and at >= f["start"]:
            self.out.append((at, "agent_efficiency_first_spawn_seconds", [], (at - f["start"]) / SECOND))
        f |= {"spawned": True, "role": "root" if f["role"] == "solo" else f["role"]}

    def delivered(self, e, call: dict, marks: str) -> None:
        kinds, key = call["delivery"].split("+"), None
        if kinds[0].startswith("@"):
            key = kinds[0][1:]
            process = self.processes.get(key) or {}
            if not process.get("delivery"):
                return
            kinds, marks = process["delivery"].split("+"), marks + process["marks"]
        if call["background"] or e.background:
            kinds, code = [k for k in kinds if k != "cr"], None
        else:
            code = e.exit
            for severity in list(e.findings) if "cr" in kinds and e.findings is not None else []:
                self.add("coderabbit_findings_total", 1, self.f["role"], severity)
            if code is None and (key is not None or e.running is not None or "s" in marks):  # it still runs
                known = key or e.running
                if known is not None:
                    before = self.processes.pop(known, None) or {"target": "other"}
                    self.processes[known] = {"target": before["target"], "delivery": "+".join(kinds), "marks": "".join(sorted(set(marks)))}
                return
            if key is not None:
                self.processes.pop(key, None)
        outcome = "unknown" if code is None else "success" if code == 0 else "failure"
        names = {"push": "git_pushes_total", "gate": "gate_runs_total", "ci": "ci_waits_total"}
        for kind in kinds:
            if kind in names:
                self.add(names[kind], 1, self.f["role"], "cancelled" if kind == "ci" and "x" in marks else outcome)
            elif kind == "cr" and (code is not None or "c" in marks or "r" in marks):
                self.add("coderabbit_reviews_total", 1, self.f["role"], "complete" if "c" in marks else "rate_limited" if "r" in marks else "failed")


_WHOLE = {c: "Int64" for c in ("byte_offset", "n", "at", "spawns", "total", "hit", "output", "exit")}


def _frame(thread: Thread, key: tuple) -> pd.DataFrame:
    rows = [(key[0], key[1], thread.f["uid"], at, metric, labels, amount) for at, metric, labels, amount in thread.out]
    return pd.DataFrame(rows, columns=["agent", "thread", "uid", "at", "metric", "labels", "amount"])


def _rows(frames: Iterator[pd.DataFrame]) -> Iterator:
    """A micro-batch's events of a thread in their order."""
    rows = pd.concat(list(frames)).sort_values(["byte_offset", "n"], kind="stable").astype(_WHOLE).astype(object)
    yield from rows.where(rows.notna(), None).itertuples(index=False)


class Collector(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.facts = handle.getValueState("facts", _FACTS + ", timer long")
        self.pending = handle.getMapState("pending", "id string", _PENDING)
        self.processes = handle.getMapState("processes", "id string", _PROCESS + ", n long")
        self.ids = handle.getMapState("ids", "id string", "n int", REMEMBERED_MS) if self.remembers else handle.getMapState("ids", "id string", "n int")

    def __init__(self, remembers: bool = False):
        self.remembers = remembers

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = dict(zip([*_NAMES, "timer"], self.facts.get(), strict=True)) if self.facts.exists() else None
        timer = known.pop("timer") if known else None
        names = [c.split()[0] for c in _PENDING.split(", ")]
        pending = dict(sorted(((k[0], dict(zip(names, v, strict=True))) for k, v in self.pending.iterator()), key=lambda x: x[1]["turn"]))
        processes = {k[0]: {"target": v[0], "delivery": v[1], "marks": v[2]} for k, v in sorted(self.processes.iterator(), key=lambda x: x[1][3])}
        ids = {k[0]: True for k in self.ids.keys()}
        before = set(pending), set(processes), set(ids)
        thread = Thread(key[0], known, pending, processes, ids)
        for e in _rows(rows):
            thread.step(e)
        for state, old, new in ((self.pending, before[0], pending), (self.processes, before[1], processes)):
            for gone in old - set(new):
                state.removeKey((gone,))
        for turn, (k, v) in enumerate(pending.items()):
            self.pending.updateValue((k,), tuple({**v, "turn": turn}[n] for n in names))
        for n, (k, v) in enumerate(processes.items()):
            self.processes.updateValue((k,), (v["target"], v["delivery"], v["marks"], n))
        for k in set(ids) - before[2]:
            self.ids.updateValue((k,), (1,))
        f = thread.f
        if f["role"] == "worker" and f["lane"] is not None and f["last"] is not None:
            due = (f["last"] + GAP) // 1_000 + 1
            if timer != due:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(due)
                timer = due
        self.facts.update((*(f[n] for n in _NAMES), timer))
        if thread.out:
            yield _frame(thread, key)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = dict(zip([*_NAMES, "timer"], self.facts.get(), strict=True))
        known.pop("timer")
        thread = Thread(key[0], known, {}, {}, {})
        thread.close(known["lane"], known["last"])
        known["lane"] = None
        self.facts.update((*(known[n] for n in _NAMES), None))
        if thread.out:
            yield _frame(thread, key)


def collected(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Increments (OUTPUT) of a stream of activity events. The session needs RocksDB as its state store. The watermark only closes
    lanes: no event is left out for being late, as a thread's order is that of its file."""
    timed = events.withColumn("_at", F.timestamp_micros("at")).withWatermark("_at", late)
    return timed.groupBy("agent", "thread").transformWithStateInPandas(Collector(), OUTPUT, "Append", "EventTime")


def _whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Threads one after the other, from rows sorted by thread and place."""
    thread, key = None, None
    for batch in batches:
        rows = batch.astype(_WHOLE).astype(object)
        for e in rows.where(rows.notna(), None).itertuples(index=False):
            if key != (e.agent, e.thread):
                if thread is not None and thread.out:
                    yield _frame(thread, key)
                thread, key = Thread(e.agent, None, {}, {}, {}), (e.agent, e.thread)
            thread.step(e)
        if thread is not None and thread.out:
            yield _frame(thread, key)
            thread.out = []


def collected_at_once(events: DataFrame) -> DataFrame:
    """The increments of whole logs, lanes that are still open apart: a task streams through its threads, holding one's open calls."""
    return events.repartition("agent", "thread").sortWithinPartitions("agent", "thread", "byte_offset", "n").mapInPandas(_whole, OUTPUT)


def totals(increments: DataFrame, *by: str) -> DataFrame:
    """metric, labels (a map) and value: counters' sums, and histograms as cumulative buckets (label le), _sum and _count. by: columns
    of the increments (agent, a joined loop, ...) that are labels too."""
    given = increments.withColumn("_by", F.map_from_arrays(F.array(*[F.lit(b) for b in by]), F.array(*[F.col(b).cast("string") for b in by])) if by else F.create_map().cast("map<string,string>"))
    names = F.create_map(*[x for m, labels in COUNTERS.items() for x in (F.lit(m), F.array(*[F.lit(v) for v in labels]).cast("array<string>"))])
    counters = given.filter(F.col("metric").isin(*COUNTERS)).select("metric", "_by", F.map_from_arrays(F.element_at(names, F.col("metric")), "labels").alias("_own"), "amount")
    parts = []
    for metric, bounds in HISTOGRAMS.items():
        own = given.filter(F.col("metric") == metric)
        reached = F.filter(F.array(*[F.struct(F.lit(float(b)).alias("b"), F.lit(str(b)).alias("le")) for b in bounds], F.struct(F.lit(float("inf")).alias("b"), F.lit("+Inf").alias("le"))), lambda x: F.col("amount") <= x["b"])
        parts += [own.select(F.lit(f"{metric}_bucket").alias("metric"), "_by", F.explode(F.transform(reached, lambda x: F.create_map(F.lit("le"), x["le"]))).alias("_own"), F.lit(1.0).alias("amount"))]
        parts += [own.select(F.lit(f"{metric}_{n}").alias("metric"), "_by", F.create_map().cast("map<string,string>").alias("_own"), value.alias("amount")) for n, value in (("sum", F.col("amount")), ("count", F.lit(1.0)))]
    every = counters
    for part in parts:
        every = every.unionByName(part)
    labels = F.array_sort(F.map_entries(F.map_concat("_by", "_own")))
    return every.withColumn("labels", labels).groupBy("metric", "labels").agg(F.sum("amount").alias("value")).select("metric", F.map_from_entries("labels").alias("labels"), "value")
