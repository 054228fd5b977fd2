"""What runs are doing now: recorded events folded to one state a run, with what is unknown told as such.

Events (EVENT): a run's root writes open, admit, dispatch, return, gate, park, land, judgement, watch, heartbeat and close; a writer
that can't be read leaves an uncertain event, which says what it may have been (for_ev; null: anything). The fold keeps what order
alone decides (the last dispatch or return of a lane, the last gate), so it is the same for events in any order and any cut, and
the stream of loomlog.streaming.live keeps the same state. judged() turns a state and a time into a phase.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENT = (
    "loop_id string, at timestamp, seq long, ev string, lane string, run string, task string, agent string, scope string, exit_code int, text string, "
    "what string, op string, until timestamp, for_ev string, observed boolean, read_only boolean, call string, call_order int"
)
#: A run's state, from which judged() reads.
STATE = (
    "loop_id string, opened boolean, closed boolean, active_at timestamp, beat_at timestamp, dispatched_at timestamp, landed_at timestamp, "
    "lanes long, roles array<string>, watched_until timestamp, parks long, park_task string, gate_scope string, gate_exit int, note string, "
    "admitted long, landed long, unknown array<string>"
)
#: Seconds within which a second heartbeat doesn't count.
BEAT = 300
#: Minutes after which a land, silence without lanes, and silence with lanes count as over.
LANDING, QUIET, STALE = 10, 15, 60


def role(agent: Column) -> Column:
    """What a lane is for, by its agent's name (without a plugin's name before a colon)."""
    name = F.regexp_replace(F.coalesce(agent, F.lit("")), "^.*:", "")
    return F.when(name.startswith("gate-runner"), "gate").when(name.rlike("^(reviewer|security-reviewer|lane-reviewer$)"), "review").when(name.rlike("^(lane-)?scout$"), "scout").otherwise("implementation")


def lane_key(run: Column, lane: Column) -> Column:
    return F.coalesce(F.nullif(run, F.lit("")), F.nullif(lane, F.lit("")))


def doubts(events: DataFrame) -> DataFrame:
    """Uncertain events, and dispatches and returns that name no lane, which leave the lanes unknown."""
    nameless = F.col("ev").isin("dispatch", "return") & lane_key(F.col("run"), F.col("lane")).isNull()
    kind, seen = F.when(nameless, F.col("ev")).otherwise(F.col("for_ev")), F.coalesce("observed", F.lit(False)) | (nameless & (F.col("ev") == "dispatch"))
    rows = events.filter((F.col("ev") == "uncertain") | nameless)
    return rows.select("loop_id", "at", kind.alias("for_ev"), F.when(~nameless, F.col("task")).alias("task"), seen.alias("observed"), F.coalesce("read_only", F.lit(False)).alias("read_only"), "call", "call_order")


def last_beat(times: Column) -> Column:
    """The last heartbeat that counts: the first, then each that comes BEAT seconds or more after the last one that counted."""
    later = lambda done, t: F.when(done.isNull() | (F.unix_micros(t) - F.unix_micros(done) >= BEAT * 1_000_000), t).otherwise(done)
    return F.aggregate(F.array_sort(times), F.lit(None).cast("timestamp"), later)


def fold(events: DataFrame) -> DataFrame:
    """One STATE row a run. Null run ids and rows without a time or kind count for nothing; repeated rows change nothing but the number of
    parks, unless they repeat seq too. Ties in time go to the greater seq. Without events there are no rows."""
    e = events.filter("loop_id IS NOT NULL AND at IS NOT NULL AND ev IS NOT NULL").dropDuplicates(["loop_id", "at", "seq", "ev"])
    order, is_ = F.struct("at", "seq"), lambda *kinds: F.col("ev").isin(*kinds)
    last = lambda value, when: F.max_by(value, F.when(when, order))
    known = lambda kind, when: F.max_by(F.struct("at", "call", "call_order"), F.when(when, order)).alias(kind)
    noted = is_("judgement") & F.col("text").isNotNull()
    facts = e.groupBy("loop_id").agg(
        F.bool_or(is_("open")).alias("opened"), F.bool_or(is_("close")).alias("closed"), F.max(F.when(~is_("heartbeat", "uncertain"), F.col("at"))).alias("active_at"),
        F.max(F.when(is_("dispatch"), F.col("at"))).alias("dispatched_at"), F.max(F.when(is_("land"), F.col("at"))).alias("landed_at"), F.count_if(is_("park")).alias("parks"),
        last(F.col("task"), is_("park")).alias("park_task"), last(F.col("scope"), is_("gate")).alias("gate_scope"), last(F.col("exit_code"), is_("gate")).alias("gate_exit"), last(F.left("text", F.lit(500)), noted).alias("note"),
        known("_park", is_("park")), known("_gate", is_("gate")), known("_note", noted),
    )
    beats = e.filter(is_("heartbeat")).groupBy("loop_id").agg(last_beat(F.collect_set("at")).alias("beat_at"))  # eight bytes a heartbeat
    keyed = e.filter(is_("dispatch", "return")).withColumn("key", lane_key(F.col("run"), F.col("lane"))).filter("key IS NOT NULL")
    live = keyed.groupBy("loop_id", "key").agg(F.max_by(F.struct("ev", role(F.col("agent")).alias("role")), order).alias("l")).filter("l.ev = 'dispatch'")
    lanes = live.groupBy("loop_id").agg(F.count("*").alias("lanes"), F.array_sort(F.collect_set("l.role")).alias("roles"))
    watches = e.filter(is_("watch") & F.col("what").isNotNull() & F.col("op").isin("start", "stop")).groupBy("loop_id", "what").agg(F.max_by(F.struct("op", F.coalesce("until", "at").alias("until")), order).alias("w"))
    watched = watches.filter("w.op = 'start'").groupBy("loop_id").agg(F.max("w.until").alias("watched_until"))
    tasks = e.filter(is_("admit", "land") & (F.col("task") != "")).select("loop_id", "ev", "task").distinct()
    counted = tasks.groupBy("loop_id").agg(F.count_if(is_("admit")).alias("admitted"), F.count_if(is_("land")).alias("landed"))
    out = facts
    for part in (beats, lanes, watched, counted, _unknown(doubts(e), facts, tasks)):
        out = out.join(part, "loop_id", "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in ("lanes", "admitted", "landed")}
    none = F.lit(None).cast("array<string>")
    out = out.withColumns(zero | {"roles": F.coalesce("roles", F.array().cast("array<string>")), "unknown": F.coalesce("unknown", none, F.array().cast("array<string>"))})
    return out.select(*[c.split()[0] for c in STATE.split(", ")])


def _unknown(doubts: DataFrame, facts: DataFrame, tasks: DataFrame) -> DataFrame:
    """(loop_id, unknown): what the doubts leave open. A total is open for good; of a snapshot only doubts count that may be later."""
    of = lambda *kinds: F.col("for_ev").isNull() | F.col("for_ev").isin(*kinds)

    def after(name: str) -> Column:
        snap = F.col(name)
        ordered = F.coalesce((F.col("call") == snap["call"]) & (F.coalesce("call_order", F.lit(0)) < F.coalesce(snap["call_order"], F.lit(0))), F.lit(False))
        return snap.isNull() | (F.col("at") > snap["at"]) | ((F.col("at") == snap["at"]) & ~ordered)

    named = tasks.select("loop_id", "task", F.col("ev").alias("_ev"))
    met = doubts.join(facts.select("loop_id", "_park", "_gate", "_note"), "loop_id")
    for kind in ("admit", "land"):
        own = named.filter(F.col("_ev") == kind).select("loop_id", "task", F.lit(True).alias(f"_{kind}"))
        met = met.join(own, ["loop_id", "task"], "left")
    flags = {
        "lanes": of("dispatch", "return"), "parks": of("park"), "park": of("park") & after("_park"), "gate": of("gate") & after("_gate"), "note": of("judgement") & after("_note"),
        "admitted": of("admit") & F.col("_admit").isNull(), "landed": of("land") & F.col("_land").isNull(),
        "phase": (F.col("for_ev").isin("dispatch", "return", "close", "watch") & ~F.col("observed")) | (F.col("for_ev").isNull() & ~F.col("read_only")),
    }
    names = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in flags.items()]))
    return met.select("loop_id", F.explode(names).alias("n")).groupBy("loop_id").agg(F.array_sort(F.collect_set("n")).alias("unknown"))


def judged(states: DataFrame, now: Column) -> DataFrame:
    """phase and the figures of a run at a time: null is unknown, or nothing that tells it was seen.

    The phase is the first that holds: closing (a close), gating (a watch that hasn't run out), preparing (no lane yet), landing (a land in the
    last minutes and nothing dispatched since), waiting (lanes, but silence), gating, reviewing or working (by the lanes' roles), waiting
    (silence), working.
    """
    has = lambda role_: F.array_contains("roles", role_)
    sure = lambda name: ~F.array_contains("unknown", name)
    seen = F.greatest("active_at", "beat_at")
    minutes = lambda at: F.greatest((F.unix_micros(now) - F.unix_micros(at)) / 60_000_000, F.lit(0.0))
    watching, began = F.coalesce(F.col("watched_until") > now, F.lit(False)), F.col("opened") | F.col("dispatched_at").isNotNull()
    landing = F.col("landed_at").isNotNull() & (F.col("dispatched_at") <= F.col("landed_at")) & (minutes(F.col("landed_at")) <= LANDING)
    phase = (
        F.when(F.col("closed"), "closing").when(watching, "gating").when(F.col("dispatched_at").isNull(), "preparing").when(landing, "landing")
        .when((F.col("lanes") > 0) & (minutes(seen) > STALE), "waiting").when(has("gate"), "gating").when((F.size("roles") == 1) & has("review"), "reviewing").when(has("implementation"), "working")
        .when(minutes(seen) > QUIET, "waiting").otherwise("working")
    )
    told = began | watching | F.col("beat_at").isNotNull() | F.col("closed")
    return states.select(
        "loop_id", F.when(told & (sure("phase") | watching | F.col("closed")), phase).alias("phase"), F.when(began & sure("lanes"), F.col("lanes")).alias("active_lanes"),
        F.when(((F.col("parks") > 0) | F.col("opened")) & sure("parks"), F.col("parks")).alias("parks"), F.when(sure("park"), F.col("park_task")).alias("park_task"),
        F.when(sure("gate"), F.col("gate_scope")).alias("gate_scope"), F.when(sure("gate"), F.col("gate_exit")).alias("gate_exit"), F.when(sure("note"), F.col("note")).alias("note"),
        F.when(((F.col("admitted") > 0) | F.col("opened")) & sure("admitted"), F.col("admitted")).alias("tasks_admitted"), F.when(((F.col("landed") > 0) | F.col("opened")) & sure("landed"), F.col("landed")).alias("tasks_landed"),
        F.floor(minutes(seen)).alias("quiet_minutes"),
    )
