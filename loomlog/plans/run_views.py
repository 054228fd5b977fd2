"""Queries over events of runs made from the event stream; the same events in SQL stand before each query's own SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomlog.operators import search
from loomlog.operators.accept import AcceptSpec, accept_fold
from loomlog.operators.snippets import snippets

from . import live, state_log
from .catalogue import query

#: The time as of which runs are judged.
NOW = "2024-01-20 12:00:00"

_ELEMENT = lambda values, by: F.get(F.array(*[F.lit(v) for v in values]), by.cast("int"))
_KINDS = ("open", "admit", "admit", "admit", "dispatch", "dispatch", "dispatch", "dispatch", "return", "return", "return", "gate", "park", "land", "judgement", "watch", "heartbeat", "heartbeat")
_AGENTS = ("gate-runner", "reviewer", "x:lane-scout", "builder")
_DOUBTS = (None, "dispatch", "park", "gate", "land", "admit", "judgement")
_list = lambda values: "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"

EVENTS_SQL = f"""WITH raw AS (SELECT *, regexp_extract(props, '([0-9]+)', 1)::BIGINT AS k, event_id AS i, user_id AS u FROM events WHERE ts <= TIMESTAMP '{NOW}'),
ev AS (SELECT 'u' || u AS loop_id, ts AS tm, i AS seq,
    CASE WHEN k % 20 = 19 AND u % 5 = 0 AND k = 99 THEN 'close' WHEN k % 20 = 18 AND u % 3 = 0 THEN 'uncertain' WHEN k % 20 = 18 THEN 'land' WHEN k % 20 = 19 THEN 'heartbeat' ELSE {_list(_KINDS)}[k % 20 + 1] END AS ev,
    CASE WHEN i % 37 <> 0 THEN 'l' || (i % 5) END AS lane, CASE WHEN i % 4 = 0 AND i % 37 <> 0 THEN 'r' || (i % 3) END AS run, CASE WHEN i % 11 <> 0 THEN 't' || (i % 9) END AS task, {_list(_AGENTS)}[i % 4 + 1] AS agent,
    's' || k AS scope, CASE WHEN i % 13 <> 0 THEN (i % 2)::INT END AS exit_code, CASE WHEN i % 10 <> 0 THEN 'note ' || i END AS text, 'w' || (i % 3) AS what, CASE WHEN i % 2 = 0 THEN 'start' ELSE 'stop' END AS op,
    CASE WHEN i % 7 <> 0 THEN ts + INTERVAL 3 DAY END AS until, {_list(_DOUBTS)}[i % 7 + 1] AS for_ev, i % 2 = 0 AS observed, i % 3 = 0 AS read_only, 'c' || (i % 2) AS call, (i % 4)::INT AS call_order FROM raw)
"""


def run_events(t) -> DataFrame:
    """Events of runs (live.EVENT) up to NOW: users stand for runs, the number in props for the kind."""
    k, i, u = F.col("k"), F.col("event_id"), F.col("user_id")
    raw = t("events").filter(F.col("ts").cast("timestamp") <= F.lit(NOW).cast("timestamp")).withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("long"))
    kind = F.when((k % 20 == 19) & (u % 5 == 0) & (k == 99), "close").when((k % 20 == 18) & (u % 3 == 0), "uncertain").when(k % 20 == 18, "land").when(k % 20 == 19, "heartbeat").otherwise(_ELEMENT(_KINDS, k % 20))
    named = lambda letter, number: F.concat(F.lit(letter), number.cast("string"))
    at = F.col("ts").cast("timestamp")
    return raw.select(
        named("u", u).alias("loop_id"), at.alias("at"), i.alias("seq"), kind.alias("ev"), F.when(i % 37 != 0, named("l", i % 5)).alias("lane"), F.when((i % 4 == 0) & (i % 37 != 0), named("r", i % 3)).alias("run"),
        F.when(i % 11 != 0, named("t", i % 9)).alias("task"), _ELEMENT(_AGENTS, i % 4).alias("agent"), named("s", k).alias("scope"), F.when(i % 13 != 0, (i % 2).cast("int")).alias("exit_code"), F.when(i % 10 != 0, named("note ", i)).alias("text"),
        named("w", i % 3).alias("what"), F.when(i % 2 == 0, "start").otherwise("stop").alias("op"), F.when(i % 7 != 0, at + F.expr("INTERVAL 3 DAYS")).alias("until"), _ELEMENT(_DOUBTS, i % 7).alias("for_ev"),
        (i % 2 == 0).alias("observed"), (i % 3 == 0).alias("read_only"), named("c", i % 2).alias("call"), (i % 4).cast("int").alias("call_order"),
    )


_LIVE_SQL = f"""{EVENTS_SQL}, keyed AS (SELECT *, coalesce(nullif(run, ''), nullif(lane, '')) AS key FROM ev),
facts AS (SELECT loop_id, bool_or(ev = 'open') AS opened, bool_or(ev = 'close') AS closed, max(tm) FILTER (WHERE ev NOT IN ('heartbeat', 'uncertain')) AS active_at, max(tm) FILTER (WHERE ev = 'dispatch') AS dispatched_at, max(tm) FILTER (WHERE ev = 'land') AS landed_at,
    count(*) FILTER (WHERE ev = 'park') AS parks, arg_max({{'t': task, 'tm': tm, 'c': call, 'o': call_order}}, (tm, seq)) FILTER (WHERE ev = 'park') AS park, arg_max({{'s': scope, 'x': exit_code, 'tm': tm, 'c': call, 'o': call_order}}, (tm, seq)) FILTER (WHERE ev = 'gate') AS gate,
    arg_max({{'t': text, 'tm': tm, 'c': call, 'o': call_order}}, (tm, seq)) FILTER (WHERE ev = 'judgement' AND text IS NOT NULL) AS note FROM ev GROUP BY 1),
beats AS (SELECT loop_id, make_timestamp(list_reduce(list_sort(list(epoch_us(tm))), lambda d, x: CASE WHEN x - d >= 300000000 THEN x ELSE d END)) AS beat_at FROM ev WHERE ev = 'heartbeat' GROUP BY 1),
lanes AS (SELECT loop_id, count(*) AS lanes, list(DISTINCT CASE regexp_replace(agent, '^.*:', '') WHEN 'gate-runner' THEN 'gate' WHEN 'reviewer' THEN 'review' WHEN 'lane-scout' THEN 'scout' ELSE 'implementation' END) AS roles
    FROM (SELECT * FROM keyed WHERE ev IN ('dispatch', 'return') AND key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY loop_id, key ORDER BY tm DESC, seq DESC) = 1) WHERE ev = 'dispatch' GROUP BY 1),
watched AS (SELECT loop_id, max(coalesce(until, tm)) AS watched_until FROM (SELECT * FROM ev WHERE ev = 'watch' QUALIFY row_number() OVER (PARTITION BY loop_id, what ORDER BY tm DESC, seq DESC) = 1) WHERE op = 'start' GROUP BY 1),
tasks AS (SELECT DISTINCT loop_id, ev, task FROM ev WHERE ev IN ('admit', 'land') AND task <> ''),
counted AS (SELECT loop_id, count(*) FILTER (WHERE ev = 'admit') AS admitted, count(*) FILTER (WHERE ev = 'land') AS landed FROM tasks GROUP BY 1),
doubts AS (SELECT loop_id, tm, for_ev, task, observed, read_only, call, call_order FROM ev WHERE ev = 'uncertain'
    UNION ALL SELECT loop_id, tm, ev, NULL, observed OR ev = 'dispatch', read_only, call, call_order FROM keyed WHERE ev IN ('dispatch', 'return') AND key IS NULL),
unknown AS (SELECT d.loop_id, bool_or(for_ev IS NULL OR for_ev IN ('dispatch', 'return')) AS u_lanes, bool_or(for_ev IS NULL OR for_ev = 'park') AS u_parks,
    bool_or((for_ev IS NULL OR for_ev = 'park') AND (park IS NULL OR tm > park.tm OR (tm = park.tm AND NOT (call = park.c AND call_order < park.o)))) AS u_park,
    bool_or((for_ev IS NULL OR for_ev = 'gate') AND (gate IS NULL OR tm > gate.tm OR (tm = gate.tm AND NOT (call = gate.c AND call_order < gate.o)))) AS u_gate,
    bool_or((for_ev IS NULL OR for_ev = 'judgement') AND (note IS NULL OR tm > note.tm OR (tm = note.tm AND NOT (call = note.c AND call_order < note.o)))) AS u_note,
    bool_or((for_ev IS NULL OR for_ev = 'admit') AND NOT EXISTS (FROM tasks t WHERE t.loop_id = d.loop_id AND t.ev = 'admit' AND t.task = d.task)) AS u_admitted,
    bool_or((for_ev IS NULL OR for_ev = 'land') AND NOT EXISTS (FROM tasks t WHERE t.loop_id = d.loop_id AND t.ev = 'land' AND t.task = d.task)) AS u_landed,
    bool_or((for_ev IN ('dispatch', 'return', 'close', 'watch') AND NOT observed) OR (for_ev IS NULL AND NOT read_only)) AS u_phase FROM doubts d JOIN facts USING (loop_id) GROUP BY 1),
s AS (SELECT f.*, beat_at, coalesce(lanes, 0) AS lanes, coalesce(roles, []) AS roles, coalesce(watched_until > TIMESTAMP '{NOW}', false) AS watching, coalesce(admitted, 0) AS admitted, coalesce(landed, 0) AS landed, opened OR dispatched_at IS NOT NULL AS began,
    greatest(epoch_us(TIMESTAMP '{NOW}') - epoch_us(greatest(active_at, beat_at)), 0) / 6e7 AS quiet, greatest(epoch_us(TIMESTAMP '{NOW}') - epoch_us(landed_at), 0) / 6e7 AS since_land, u.* EXCLUDE (loop_id)
    FROM facts f LEFT JOIN beats USING (loop_id) LEFT JOIN lanes USING (loop_id) LEFT JOIN watched USING (loop_id) LEFT JOIN counted USING (loop_id) LEFT JOIN unknown u USING (loop_id))
SELECT loop_id, CASE WHEN (began OR watching OR beat_at IS NOT NULL OR closed) AND (u_phase IS NOT TRUE OR watching OR closed) THEN CASE WHEN closed THEN 'closing' WHEN watching THEN 'gating' WHEN dispatched_at IS NULL THEN 'preparing'
    WHEN landed_at IS NOT NULL AND dispatched_at <= landed_at AND since_land <= 10 THEN 'landing' WHEN lanes > 0 AND quiet > 60 THEN 'waiting' WHEN list_contains(roles, 'gate') THEN 'gating' WHEN roles = ['review'] THEN 'reviewing'
    WHEN list_contains(roles, 'implementation') THEN 'working' WHEN quiet > 15 THEN 'waiting' ELSE 'working' END END AS phase,
    CASE WHEN began AND u_lanes IS NOT TRUE THEN lanes END::BIGINT AS active_lanes, CASE WHEN (parks > 0 OR opened) AND u_parks IS NOT TRUE THEN parks END::BIGINT AS parks, CASE WHEN u_park IS NOT TRUE THEN park.t END AS park_task,
    CASE WHEN u_gate IS NOT TRUE THEN gate.s END AS gate_scope, CASE WHEN u_gate IS NOT TRUE THEN gate.x END AS gate_exit, CASE WHEN u_note IS NOT TRUE THEN note.t END AS note,
    CASE WHEN (admitted > 0 OR opened) AND u_admitted IS NOT TRUE THEN admitted END::BIGINT AS tasks_admitted, CASE WHEN (landed > 0 OR opened) AND u_landed IS NOT TRUE THEN landed END::BIGINT AS tasks_landed, floor(quiet)::BIGINT AS quiet_minutes FROM s"""


@query("view_live_phase", _LIVE_SQL)
def view_live_phase(t):
    """Every run's phase and figures as of NOW."""
    return live.judged(live.fold(run_events(t)), F.lit(NOW).cast("timestamp"))


_SNAPSHOTS_SQL = """WITH RECURSIVE raw AS (SELECT *, regexp_extract(props, '([0-9]+)', 1)::BIGINT AS k, event_id AS i FROM events),
snap AS (SELECT 'u' || user_id AS session_uid, event_type AS request_id, i AS arrival, ts + to_hours(CASE WHEN k % 6 = 0 THEN -30 ELSE k % 5 END) AS written_at, CASE WHEN i % 23 = 0 THEN 'other' ELSE 'first' END AS started,
    CASE WHEN k >= 97 THEN ts WHEN k >= 94 THEN ts - INTERVAL 40 DAY END AS ended_at, CASE WHEN k >= 94 THEN 'done' ELSE 'active' END AS state, i // 50 + k % 4 AS events, CASE WHEN i % 4 <> 0 THEN i // 90 + k % 3 END AS deltas,
    CASE WHEN i % 3 = 0 THEN 'p' || (i % 29 = 0) END AS pid, CASE WHEN k % 2 = 0 THEN 'e' || (k % 5) END AS effort, CASE WHEN k % 7 <> 0 THEN 'm' || k END AS model FROM raw),
r AS (SELECT *, row_number() OVER (PARTITION BY session_uid, request_id ORDER BY arrival) AS n FROM snap),
f AS (SELECT *, 0::BIGINT AS n_accepted, 0::BIGINT AS n_refused, 0::BIGINT AS n_ignored FROM r WHERE n = 1 UNION ALL
    SELECT session_uid, request_id, CASE WHEN ok THEN b.arrival ELSE a.arrival END, CASE WHEN ok THEN b.written_at ELSE a.written_at END, a.started, CASE WHEN ok THEN b.ended_at ELSE a.ended_at END, CASE WHEN ok THEN b.state ELSE a.state END,
        CASE WHEN ok THEN b.events ELSE a.events END, CASE WHEN ok THEN b.deltas ELSE a.deltas END, CASE WHEN own THEN coalesce(a.pid, b.pid) ELSE a.pid END, CASE WHEN own THEN coalesce(a.effort, b.effort) ELSE a.effort END, CASE WHEN ok THEN b.model ELSE a.model END,
        b.n, n_accepted + ok::BIGINT, n_refused + (own AND NOT ok)::BIGINT, n_ignored + (NOT own)::BIGINT
    FROM (SELECT f AS a, r AS b, f.session_uid, f.request_id, f.n_accepted, f.n_refused, f.n_ignored, f.started = r.started AND coalesce(f.pid = r.pid, true) AS own,
        f.started = r.started AND coalesce(f.pid = r.pid, true) AND f.state = 'active' AND (r.written_at > f.written_at OR (r.written_at = f.written_at AND r.state <> 'active')) AND coalesce(r.ended_at >= f.written_at, true)
            AND coalesce(r.events >= f.events, true) AND coalesce(r.deltas >= f.deltas, true) AS ok
        FROM f JOIN r ON f.session_uid = r.session_uid AND f.request_id = r.request_id AND r.n = f.n + 1))
SELECT session_uid, request_id, arrival, epoch_us(written_at)::BIGINT AS written_at, state, events, deltas, pid, effort, model, n_accepted, n_refused, n_ignored FROM f QUALIFY row_number() OVER (PARTITION BY session_uid, request_id ORDER BY n DESC) = 1"""

SNAPSHOT = AcceptSpec(("session_uid", "request_id"), "arrival", "written_at", "started", "ended_at", "state", ("events", "deltas"), ("pid",), ("pid", "effort"))


def run_snapshots(t) -> DataFrame:
    """Snapshots of requests: users and event types stand for requests, the number in props for what goes wrong."""
    k, i = F.col("k"), F.col("event_id")
    raw = t("events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("k"))
    named = lambda letter, number: F.concat(F.lit(letter), number.cast("string"))
    at = F.unix_micros("ts")
    hours = F.when(k % 6 == 0, F.lit(-30)).otherwise(k % 5)
    return raw.select(
        named("u", F.col("user_id")).alias("session_uid"), F.col("event_type").alias("request_id"), i.alias("arrival"), (at + hours * 3_600_000_000).alias("written_at"), F.when(i % 23 == 0, "other").otherwise("first").alias("started"),
        F.when(k >= 97, at).when(k >= 94, at - 40 * 86_400_000_000).alias("ended_at"), F.when(k >= 94, "done").otherwise("active").alias("state"), (F.floor(i / 50) + k % 4).alias("events"), F.when(i % 4 != 0, F.floor(i / 90) + k % 3).alias("deltas"),
        F.when(i % 3 == 0, named("p", i % 29 == 0)).alias("pid"), F.when(k % 2 == 0, named("e", k % 5)).alias("effort"), F.when(k % 7 != 0, named("m", k)).alias("model"),
    )


@query("view_snapshots_accepted_in_turn", _SNAPSHOTS_SQL)
def view_snapshots_accepted_in_turn(t):
    """What counts of each request's snapshots, each held against the last accepted one."""
    return accept_fold(run_snapshots(t), SNAPSHOT).drop("started", "ended_at")


#: What a frame of each kind holds, by the number in props (k % 9); kind 8 does not fit its schema where k = 98.
_BODIES = (
    ("admit", '"task": "t{n}", "source": "envelope", "owned": ["a"], "accept": "x"'),
    ("dispatch", '"lane": "l{n}", "task": "t{n}", "agent": "a", "run": "r", "base": "b", "tier": "guarded"'),
    ("return", '"lane": "l{n}", "run": "r", "status": "complete", "exit": null, "coderabbit": {"ran": true, "major": 1, "unreviewed": 0}'),
    ("accept", '"task": "t{n}", "accepted": {ok}, "reason": "r"'),
    ("park", '"task": "t{n}", "reason": "r", "needs": "owner"'),
    ("land", '"task": "t{n}", "sha": "s", "gate": "g", "mode": "after-green"'),
    ("heartbeat", '"at": "soon"'),
    ("close", '"reason": "budget"'),
    ("judgement", '"text": {text}'),
)
_FILL = {"{n}": "n", "{ok}": "ok", "{text}": "text"}


def _pieces(body: str) -> list[str]:
    """A body cut at its places."""
    out = [body]
    for mark in _FILL:
        out = [p for x in out for p in ([y for z in x.split(mark) for y in (z, mark)][:-1] if x not in _FILL else [x])]
    return [p for p in out if p]


_as_sql = lambda body: " || ".join(_FILL[p] if p in _FILL else "'" + p.replace("'", "''") + "'" for p in _pieces(body))
_LINES_SQL = f"""WITH raw AS (SELECT *, regexp_extract(props, '([0-9]+)', 1)::BIGINT AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
c AS (SELECT *, unnest([0, 1]) AS copy FROM raw),
f AS (SELECT user_id, copy, rn, k, event_id, CASE WHEN rn = 1 THEN 'open' ELSE {_list([b[0] for b in _BODIES])}[k % 9 + 1] END AS ev, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts, (k % 4)::VARCHAR AS n, CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END AS ok,
    CASE WHEN k = 98 AND user_id % 4 = 0 THEN '7' WHEN copy = 1 AND event_id % 41 = 0 THEN '"other"' ELSE '"note"' END AS text FROM c),
lines AS (SELECT 'u' || user_id || '-' || copy AS copy_id, rn AS line_no, '{{"v": 1, "seq": ' || (rn + CASE WHEN user_id % 11 = 5 AND rn > 20 THEN 1 ELSE 0 END) || ', "ts": "' || ts || '", "by": "' || CASE WHEN k % 5 = 0 THEN 'daemon' ELSE 'root' END || '", "ev": "' || ev || '", '
    || CASE ev WHEN 'open' THEN '"goal_sha256": "' || sha256(user_id::VARCHAR) || '", "tier": "routine", "root": "llm", "root_model": "m", "envelope": []' {" ".join(f"WHEN '{ev}' THEN {_as_sql(body)}" for ev, body in _BODIES)} END
    || CASE WHEN user_id % 7 = 3 AND copy = 1 AND k = 50 THEN ', "extra": 1' ELSE '' END || '}}' AS raw FROM f
    UNION ALL SELECT DISTINCT 'u' || user_id || '-1', 1000000, '{{"v": 1, "se' FROM f),
p AS (SELECT copy_id, line_no, CASE WHEN json_valid(raw) THEN raw::JSON END AS d FROM lines WHERE NOT (NOT json_valid(raw) AND starts_with(raw, '{{') AND NOT ends_with(raw, '}}'))),
t AS (SELECT *, d->>'ev' AS ev, (d->>'seq')::BIGINT AS seq, d->>'ts' AS tm, d->>'by' AS actor, d->>'task' AS task, d->>'goal_sha256' AS goal, d->>'reason' AS reason, (d->>'accepted') = 'true' AS accepted, row_number() OVER (PARTITION BY copy_id ORDER BY line_no) AS place FROM p),
g AS (SELECT *, CASE WHEN seq <> place THEN 'order' WHEN list_contains(json_keys(d), 'extra') OR (ev = 'judgement' AND json_type(d->'text') <> 'VARCHAR') THEN 'schema' END AS issue FROM t),
judged AS (SELECT copy_id, arg_min(goal, line_no) FILTER (WHERE ev = 'open') AS goal, arg_min(tm, line_no) FILTER (WHERE ev = 'open') AS opened_at, count(*) AS frames, arg_min(issue, line_no) FILTER (WHERE issue IS NOT NULL) AS rejected, min(line_no) FILTER (WHERE issue IS NOT NULL) AS line_no FROM g GROUP BY 1),
told AS (SELECT DISTINCT j.goal, j.opened_at, seq, ev, d::VARCHAR AS body, tm, actor, task, reason, accepted FROM g JOIN judged j USING (copy_id) WHERE rejected IS NULL),
conflict AS (SELECT goal, opened_at, seq, list_sort(list(DISTINCT ev)) AS kinds, count(*) AS versions FROM told GROUP BY ALL HAVING count(*) > 1)
"""


def run_log_lines(t) -> DataFrame:
    """Lines of state logs, two copies a user: some have a wrong number, type or member, some differ, one of each two ends torn."""
    k, n = F.col("k"), (F.col("k") % 4).cast("string")
    raw = t("events").select("event_id", "user_id", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("k"))
    numbered = raw.withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    user, changed = F.col("user_id"), (F.col("copy") == 1) & (F.col("event_id") % 41 == 0)
    fill = {"{n}": n, "{ok}": F.when(k % 2 == 0, "true").otherwise("false"), "{text}": F.when((k == 98) & (user % 4 == 0), "7").when(changed, '"other"').otherwise('"note"')}
    text = lambda body: F.concat(*[fill.get(p, F.lit(p)) for p in _pieces(body)])
    numbered = numbered.withColumn("ev", F.when(F.col("rn") == 1, "open").otherwise(_ELEMENT([b[0] for b in _BODIES], k % 9)))
    ev = F.col("ev")
    body = F.when(ev == "open", F.concat(F.lit('"goal_sha256": "'), F.sha2(user.cast("string"), 256), F.lit('", "tier": "routine", "root": "llm", "root_model": "m", "envelope": []')))
    for name, own in _BODIES:
        body = body.when(ev == name, text(own))
    number = F.col("rn") + F.when((user % 11 == 5) & (F.col("rn") > 20), 1).otherwise(0)
    line = F.concat(
        F.lit('{"v": 1, "seq": '), number.cast("string"), F.lit(', "ts": "'), F.col("ts"), F.lit('", "by": "'), F.when(k % 5 == 0, "daemon").otherwise("root"), F.lit('", "ev": "'), ev, F.lit('", '), body,
        F.when((user % 7 == 3) & (F.col("copy") == 1) & (k == 50), ', "extra": 1').otherwise(""), F.lit("}"),
    )
    copy = F.concat(F.lit("u"), user.cast("string"), F.lit("-"), F.col("copy").cast("string"))
    torn = raw.select(F.concat(F.lit("u"), user.cast("string"), F.lit("-1")).alias("copy_id"), F.lit(1_000_000).cast("long").alias("line_no"), F.lit('{"v": 1, "se').alias("raw")).distinct()
    return numbered.select(copy.alias("copy_id"), F.col("rn").alias("line_no"), line.alias("raw")).unionByName(torn)


_iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(c)


@query("view_state_log_copies", f"{_LINES_SQL} SELECT copy_id, goal, opened_at, frames, rejected, line_no FROM judged")
def view_state_log_copies(t):
    """Every copy of a state log: what it opens, and why it is rejected."""
    return state_log.copies(state_log.frames(run_log_lines(t))).select("copy_id", "goal", _iso("opened_at"), "frames", "rejected", "line_no")


@query("view_state_log_conflicts", f"{_LINES_SQL} SELECT goal, opened_at, seq, array_to_string(kinds, ',') AS kinds, versions FROM conflict")
def view_state_log_conflicts(t):
    """Numbers at which copies of one run differ."""
    rows = state_log.frames(run_log_lines(t))
    return state_log.conflicts(rows, state_log.copies(rows)).select("goal", _iso("opened_at"), "seq", F.array_join("kinds", ",").alias("kinds"), "versions")


@query(
    "view_state_log_outcomes",
    f"""{_LINES_SQL}, bad AS (SELECT goal, opened_at, flatten(list(kinds)) AS bad FROM conflict GROUP BY ALL),
    facts AS (SELECT goal, opened_at, count(DISTINCT task) FILTER (WHERE ev = 'admit') AS admit, count(DISTINCT task) FILTER (WHERE ev = 'land') AS land, count(*) FILTER (WHERE ev = 'park') AS park, count(*) FILTER (WHERE ev = 'dispatch') AS dispatch,
        arg_min(tm, seq) FILTER (WHERE ev = 'close' AND actor = 'root') AS closed_at, arg_min(reason, seq) FILTER (WHERE ev = 'close' AND actor = 'root') AS close_reason FROM told GROUP BY ALL),
    accepts AS (SELECT goal, opened_at, count(*) FILTER (WHERE ok) AS accept FROM (SELECT goal, opened_at, task, arg_max(accepted, seq) AS ok FROM told WHERE ev = 'accept' GROUP BY ALL) GROUP BY ALL),
    sizes AS (SELECT goal, opened_at, count(*) FILTER (WHERE rejected IS NULL) AS copies, count(*) FILTER (WHERE rejected IS NOT NULL) AS rejected_copies FROM judged GROUP BY ALL)
    SELECT goal, opened_at, copies, rejected_copies, CASE WHEN list_contains(bad, 'admit') IS NOT TRUE THEN admit END AS tasks_admitted, CASE WHEN list_contains(bad, 'land') IS NOT TRUE THEN land END AS tasks_landed,
        CASE WHEN list_contains(bad, 'accept') IS NOT TRUE THEN coalesce(accept, 0) END AS tasks_accepted, CASE WHEN list_contains(bad, 'park') IS NOT TRUE THEN park END AS parks, CASE WHEN list_contains(bad, 'dispatch') IS NOT TRUE THEN dispatch END AS dispatches,
        CASE WHEN list_contains(bad, 'close') IS NOT TRUE THEN closed_at END AS closed_at, CASE WHEN list_contains(bad, 'close') IS NOT TRUE THEN close_reason END AS close_reason
    FROM facts LEFT JOIN accepts USING (goal, opened_at) LEFT JOIN bad USING (goal, opened_at) JOIN sizes USING (goal, opened_at)""",
)
def view_state_log_outcomes(t):
    """What each run's log tells of its tasks, as far as its copies agree."""
    rows = state_log.frames(run_log_lines(t))
    found = state_log.outcomes(rows, state_log.copies(rows))
    return found.withColumns({c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'") for c in ("opened_at", "closed_at")})


_ASKED = ((1, "heon erat thou"), (2, "und der die in"), (3, "zzz"))
_SNIPPETS_SQL = f"""WITH q(query_id, term) AS (SELECT DISTINCT a, unnest(string_split(b, ' ')) FROM (VALUES {", ".join(f"({n}, '{text}')" for n, text in _ASKED)}) v(a, b)),
p AS (SELECT doc_id, text, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+')) AS piece, unnest(range(len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+')))) AS n FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, lower(piece) AS term, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY n) AS stop, length(piece) AS size FROM p),
m AS (SELECT query_id, doc_id, term, (stop - size)::BIGINT AS start, stop::BIGINT AS stop FROM s JOIN q USING (term)),
w AS (SELECT query_id, doc_id, start, stop, list({{'t': term, 's': stop}}) OVER (PARTITION BY query_id, doc_id ORDER BY start RANGE BETWEEN CURRENT ROW AND 240 FOLLOWING) AS near FROM m),
f AS (SELECT query_id, doc_id, start, x.t AS term, min(x.s) AS stop FROM (SELECT query_id, doc_id, start, stop AS own, unnest(near) AS x FROM w) WHERE x.s <= start + 240 OR x.s = own GROUP BY ALL),
b AS (SELECT query_id, doc_id, start, count(*) AS covered, max(stop) AS stop FROM f GROUP BY query_id, doc_id, start QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY count(*) DESC, max(stop) - start, start) = 1),
c AS (SELECT query_id, doc_id, covered, text, length(text) AS size, greatest(least(start - greatest(240 - (stop - start), 0) // 2, length(text) - 240), 0) AS a, stop FROM b JOIN documents USING (doc_id)),
e AS (SELECT *, least(greatest(a + 240, stop), size) AS z FROM c)
SELECT query_id, doc_id, covered::BIGINT AS covered, CASE WHEN a > 0 THEN '...' ELSE '' END || substring(text, a + 1, z - a) || CASE WHEN z < size THEN '...' ELSE '' END AS snippet FROM e"""


@query("search_snippets", _SNIPPETS_SQL)
def search_snippets(t):
    """For every document that tells a term of a query, the stretch that tells most of them."""
    docs = t("documents").select("doc_id", "text")
    asked = docs.sparkSession.createDataFrame(_ASKED, "query_id int, query string")
    hits = search.bm25(docs, "doc_id", "text", asked)
    return snippets(hits, docs, "doc_id", "text", asked)
