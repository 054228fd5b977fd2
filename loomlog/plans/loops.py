"""Orchestration runs ("loops"): windows of a root session between launches, their receipts, states and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.operators import temporal
from loomlog.operators.merge import known_sum

from . import sessions


def windows(launches: DataFrame) -> DataFrame:
    """launches (loop_id, session_uid, launched_at) with the cutoff that the session's next launch sets, and whether two began at once."""
    w = Window.partitionBy("session_uid").orderBy("launched_at", "loop_id")
    tied = F.count("*").over(Window.partitionBy("session_uid", "launched_at")) > 1
    return launches.withColumns({"cutoff": F.lead("launched_at").over(w), "tied": tied})


def receipts_in_window(loops: DataFrame, receipts: DataFrame) -> DataFrame:
    """The first receipt (session_uid, received_at, verdict) of each loop's window. Loops that began at one time with another get none."""
    inside = (F.col("received_at") >= F.col("launched_at")) & (F.col("cutoff").isNull() | (F.col("received_at") < F.col("cutoff")))
    found = loops.filter("NOT tied").join(receipts, "session_uid").filter(inside)
    return found.groupBy("loop_id").agg(F.min(F.struct("received_at", "verdict")).alias("r")).select("loop_id", "r.received_at", "r.verdict")


def lifecycle(loops: DataFrame, done: DataFrame, waits: DataFrame, last_event: DataFrame, now, stale_hours: int = 24) -> DataFrame:
    """loops with state: finished (a receipt or a later launch), paused, waiting (a wait that hasn't run out), stale, else running.

    done: receipts_in_window; waits: loop_id, at, until, kind ('wait', 'pause', 'resume'), of which the last counts;
    last_event: session_uid, last_ts. now is a timestamp.
    """
    wait = waits.groupBy("loop_id").agg(F.max_by(F.struct("kind", "until"), "at").alias("w")).select("loop_id", F.col("w.kind").alias("wait_kind"), F.col("w.until").alias("wait_until"))
    all_ = loops.join(done, "loop_id", "left").join(wait, "loop_id", "left").join(last_event, "session_uid", "left")
    t = F.lit(now).cast("timestamp")
    state = (
        F.when(F.col("received_at").isNotNull() | F.col("cutoff").isNotNull(), "finished")
        .when(F.col("wait_kind") == "pause", "paused")
        .when((F.col("wait_kind") == "wait") & (F.col("wait_until").isNull() | (F.col("wait_until") > t)), "waiting")
        .when(F.coalesce("last_ts", "launched_at") < t - F.expr(f"INTERVAL {stale_hours} HOURS"), "stale")
        .otherwise("running")
    )
    return all_.withColumn("state", state)


def progress(loops: DataFrame, lanes: DataFrame, calls: DataFrame) -> DataFrame:
    """Tokens of each loop: the root session's calls within the window and all calls of its lanes (loop_id, session_uid). A total
    is null if any part is unknown."""
    inside = (F.col("ts") >= F.col("launched_at")) & (F.col("cutoff").isNull() | (F.col("ts") < F.col("cutoff")))
    own = loops.join(calls, "session_uid").filter(inside).select("loop_id", "input_tokens", "output_tokens")
    theirs = lanes.join(calls, "session_uid").select("loop_id", "input_tokens", "output_tokens")
    return own.unionByName(theirs).groupBy("loop_id").agg(F.count("*").alias("calls"), known_sum(F.col("input_tokens")).alias("input_tokens"), known_sum(F.col("output_tokens")).alias("output_tokens"))


def orchestration_kind(tree: DataFrame) -> DataFrame:
    """One kind per root from flags of its sessions (root, launched, workflow, spawned, lane): the strongest evidence names it."""
    flags = tree.groupBy("root").agg(*[F.bool_or(c).alias(c) for c in ("launched", "workflow", "spawned", "lane")], F.count("*").alias("sessions"))
    kind = F.when(F.col("launched"), "loop").when(F.col("workflow"), "workflow").when(F.col("lane"), "lanes").when(F.col("spawned"), "subagents").when(F.col("sessions") > 1, "tree").otherwise("solo")
    return flags.withColumn("kind", kind)


def summary(loops: DataFrame, members: DataFrame, calls: DataFrame, tool_calls: DataFrame, messages: DataFrame, prices: DataFrame) -> DataFrame:
    """Totals of each loop: its root's activity within its window and its member sessions (loop_id, session_uid) whole.

    sessions counts the root too. usd is known prices' sum: unpriced calls add nothing, as a whole loop is rarely unpriced.
    """
    inside = lambda at: (F.col(at) >= F.col("launched_at")) & (F.col("cutoff").isNull() | (F.col(at) < F.col("cutoff")))
    windows = loops.select("loop_id", "session_uid", "launched_at", "cutoff")

    def parts(facts: DataFrame) -> DataFrame:
        own = windows.join(facts, "session_uid").filter(inside("ts")).drop("launched_at", "cutoff")
        return own.unionByName(members.select("loop_id", "session_uid").join(facts, "session_uid"))

    called = parts(calls)
    priced = sessions.priced(called.withColumn("agent", F.col("loop_id").cast("string")), prices).groupBy(F.col("agent").alias("_id")).agg(F.sum("usd").alias("usd"))
    made = called.groupBy("loop_id").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    used = parts(tool_calls).groupBy("loop_id").agg(F.count("*").alias("tool_calls"), F.count_if("is_error").alias("tool_errors"))
    said = parts(messages).filter("message_class = 'human_prompt'").groupBy("loop_id").agg(F.count("*").alias("prompts"))
    sizes = members.groupBy("loop_id").agg(F.countDistinct("session_uid").alias("_members"))
    out = windows.withColumn("wall_seconds", F.floor((F.unix_micros("cutoff") - F.unix_micros("launched_at")) / 1_000_000))
    for part in (made, used, said, sizes):
        out = out.join(part, "loop_id", "left")
    out = out.join(priced, F.col("loop_id").cast("string") == F.col("_id"), "left").drop("_id")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("calls", "input_tokens", "output_tokens", "tool_calls", "tool_errors", "prompts", "usd")}
    return out.withColumns(zero | {"sessions": 1 + F.coalesce("_members", F.lit(0))}).drop("_members")


def lanes(members: DataFrame, rolled: DataFrame, cost: DataFrame, spawns: DataFrame) -> DataFrame:
    """A loop's member sessions with their totals, price and how their spawn ended (spawns: session_uid, completion)."""
    return members.join(rolled, "session_uid").join(cost.select("session_uid", "usd"), "session_uid", "left").join(spawns, "session_uid", "left")


def membership(loops: DataFrame, tree: DataFrame, started: DataFrame) -> DataFrame:
    """(loop_id, session_uid, method): launch for the root, lineage for sessions of its tree that begin in its window, heuristic for
    sessions that began inside a command of one of them (started: session_uid, by_session). A session is of one loop: the earliest
    method, then the latest launch."""
    inside = (F.col("first_ts") >= F.col("launched_at")) & (F.col("cutoff").isNull() | (F.col("first_ts") < F.col("cutoff")))
    root = loops.select("loop_id", "session_uid", "launched_at", F.lit(0).alias("rank"))
    line = loops.withColumnRenamed("session_uid", "root").join(tree, "root").filter(inside & (F.col("session_uid") != F.col("root"))).select("loop_id", "session_uid", "launched_at", F.lit(1).alias("rank"))
    first = _first_loop(root.unionByName(line))
    guess = first.select("loop_id", F.col("session_uid").alias("by_session"), "launched_at").join(started, "by_session").select("loop_id", "session_uid", "launched_at", F.lit(2).alias("rank"))
    best = _first_loop(first.unionByName(guess))
    return best.select("loop_id", "session_uid", F.element_at(F.array(F.lit("launch"), F.lit("lineage"), F.lit("heuristic")), F.col("rank") + 1).alias("method"))


def _first_loop(rows: DataFrame) -> DataFrame:
    best = rows.groupBy("session_uid").agg(F.min_by(F.struct("loop_id", "launched_at", "rank"), F.struct("rank", -F.unix_micros("launched_at"), "loop_id")).alias("b"))
    return best.select("b.loop_id", "session_uid", "b.launched_at", "b.rank")


#: Fixed value: the header line of a lane's brief.
LANE_HEADER = r"^Lane: [!-~]+ · Task: ([A-Za-z][A-Za-z0-9]*-[0-9]+(?:\.[0-9]+)*) \((.+)\) · Tier: (?:routine|guarded)$"


def lane_brief_task(brief: Column) -> Column:
    """struct(task_id, title) of a brief whose first line is exactly a lane's header and whose title has at most 500 characters,
    else null: a task is never guessed from other text."""
    line = F.rtrim(F.substring_index(brief, "\n", 1), F.lit("\r"))
    part = lambda i: F.regexp_extract(line, LANE_HEADER, i)
    return F.when(line.rlike(LANE_HEADER) & (F.length(part(2)) <= 500), F.struct(part(1).alias("task_id"), part(2).alias("title")))


def tasks_done(loops: DataFrame, done: DataFrame, scanned: DataFrame) -> DataFrame:
    """(loop_id, tasks_done): distinct tasks of the loop's repository (repo) done in its window; null if that was never scanned.

    loops: loop_id, repo, launched_at, cutoff; done: repo, task_key, done_at; scanned: repo.
    """
    known = scanned.select("repo", F.lit(True).alias("_scanned")).distinct()
    seen = loops.join(known, "repo", "left")
    window = ["repo", "launched_at", "cutoff"]
    counted = _distinct_inside(seen.filter("_scanned AND launched_at IS NOT NULL").select(*window).distinct(), done)
    met = seen.alias("s").join(counted.alias("c"), (F.col("s.repo") == F.col("c.repo")) & (F.col("s.launched_at") == F.col("c.launched_at")) & F.col("s.cutoff").eqNullSafe(F.col("c.cutoff")), "left")
    return met.select("loop_id", F.when(F.col("_scanned"), F.coalesce("_n", F.lit(0))).alias("tasks_done"))


def _distinct_inside(windows: DataFrame, done: DataFrame) -> DataFrame:
    """windows (repo, launched_at, cutoff: distinct) with _n: how many distinct tasks of done are done inside. No window meets a task.

    A window holds as many tasks as times at which one is done, less the times before which the same task was done in it too. Both are
    sums over points (x, y): x from the launch on, y before the cutoff, with weight 1 at (time, time) and -1 at (time before, time). Times
    matter only by their place among launches and cutoffs, so x is the number of launches so far and y the next cutoff; equal points are added.
    Launches are cut into blocks of 1, 2, 4, ... that begin at an odd multiple: a point lies in a block for each bit of x, a window has a
    block for each bit that is 0 in the launches before it, and in a block points are added in the order of y.
    """
    times = done.filter("repo IS NOT NULL AND task_key IS NOT NULL AND done_at IS NOT NULL").select("repo", "task_key", F.col("done_at").alias("at")).distinct().join(windows.select("repo").distinct(), "repo", "left_semi")
    launches = windows.select("repo", F.col("launched_at").alias("at")).distinct()
    by_repo = Window.partitionBy("repo")
    marked = times.unionByName(launches.withColumn("launch", F.lit(1)), allowMissingColumns=True).unionByName(windows.filter("cutoff IS NOT NULL").select("repo", F.col("cutoff").alias("at"), F.col("cutoff").alias("end")).distinct(), allowMissingColumns=True)
    # a launch at a point's own time is before it, a cutoff at its own time isn't after it
    so_far = F.count("launch").over(by_repo.orderBy("at"))
    ahead = F.min("end").over(by_repo.orderBy(F.desc("at"), F.col("end").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = marked.withColumns({"x": so_far, "y": ahead})
    starts = placed.filter("launch = 1").select("repo", F.col("at").alias("launched_at"), (F.col("x") - 1).alias("_before"))
    lasts = starts.groupBy("repo").agg(F.max("_before").alias("_most"))
    told = placed.filter("task_key IS NOT NULL").withColumn("earlier", F.lag("x", 1, 0).over(Window.partitionBy("repo", "task_key").orderBy("at")))
    corners = told.select("repo", "y", F.explode(F.array(F.struct("x", F.lit(1).alias("w")), F.struct(F.col("earlier").alias("x"), F.lit(-1).alias("w")))).alias("p")).filter("p.x > 0")
    points = corners.groupBy("repo", "p.x", "y").agg(F.sum("p.w").alias("w")).filter("w <> 0")
    bits = lambda most: F.sequence(F.lit(0), F.length(F.bin(most)))
    block = F.expr("shiftright(x, level)")
    in_blocks = points.withColumn("level", F.explode(bits(F.col("x")))).withColumn("block", block).filter("block % 2 = 1").groupBy("repo", "level", "block", "y").agg(F.sum("w").alias("w"))
    asked = windows.join(starts, ["repo", "launched_at"]).join(lasts, "repo").withColumnRenamed("_before", "x").withColumn("level", F.explode(bits(F.col("_most") + 1))).withColumn("block", block + 1).filter("block % 2 = 1")
    both = in_blocks.unionByName(asked.select("repo", "level", "block", F.col("cutoff").alias("y"), "launched_at"), allowMissingColumns=True)
    in_order = Window.partitionBy("repo", "level", "block").orderBy(F.asc_nulls_last("y"), F.col("launched_at").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = both.withColumn("_n", F.sum("w").over(in_order)).filter("launched_at IS NOT NULL")
    return summed.groupBy("repo", "launched_at", F.col("y").alias("cutoff")).agg(F.sum("_n").alias("_n"))


def stalls(roots: DataFrame, children: DataFrame, now, live_minutes: int = 25, flight_minutes: int = 60) -> DataFrame:
    """(root, stalled, seconds): live roots of loops without a child in flight, and since when.

    roots: root, in_task, last_ts, spawn_ts, human_ts, paused, quiet_until; children: root, in_task, last_ts. A child that has been
    silent in its task counts as in flight for an hour; the clock starts at the last child's end, spawn or the owner's word.
    """
    at = F.unix_micros(F.lit(now).cast("timestamp"))
    minute = 60_000_000
    micros = lambda c: F.unix_micros(F.col(c))
    flying = F.col("in_task") & (at - micros("last_ts") <= flight_minutes * minute)
    until = micros("last_ts") + F.when(F.col("in_task"), F.lit(flight_minutes * minute)).otherwise(F.lit(0))
    lanes_ = children.filter("last_ts IS NOT NULL").groupBy("root").agg(F.bool_or(flying).alias("_flying"), F.max(until).alias("_until"))
    quiet = F.coalesce("paused", F.lit(False)) | F.coalesce(micros("quiet_until") > at, F.lit(False))
    live = roots.filter(F.col("in_task") & (at - micros("last_ts") <= live_minutes * minute) & ~quiet).join(lanes_, "root", "left").filter(~F.coalesce("_flying", F.lit(False)))
    lane_end = F.greatest(micros("spawn_ts"), F.col("_until"))
    since = F.when(lane_end.isNotNull(), F.greatest(lane_end, micros("human_ts")))
    return live.select("root", F.greatest(F.floor((at - since) / 1_000_000), F.lit(0)).alias("seconds"))


def labelled(events: DataFrame, loops: DataFrame, at: str = "ts", tie: str = "event_uid", none: str = "(none)") -> DataFrame:
    """events (session_uid, a time and a tie) with loop: the session's loop that was launched last before, if its window isn't over."""
    found = temporal.asof_backward(events, loops.select("session_uid", "launched_at", "loop_id", "cutoff"), ["session_uid"], at, "launched_at", "loop_id", "_loop")
    open_ = F.col("_loop.cutoff").isNull() | (F.col(at) < F.col("_loop.cutoff"))
    return found.withColumn("loop", F.coalesce(F.when(open_, F.col("_loop.loop_id").cast("string")), F.lit(none))).drop("_loop")


def lane_returns(messages: DataFrame) -> DataFrame:
    """What lanes report: the last fenced JSON object of a message (event_uid, text) that has a status, as status, task_id,
    version and the JSON itself. Line ends of either kind; blocks that aren't JSON objects are passed over."""
    text = F.replace(F.col("text"), F.lit("\r\n"), F.lit("\n"))
    blocks = F.regexp_extract_all(text, F.lit(r"(?m)^```(?:json)?[ \t]*\n([\s\S]*?)\n```[ \t]*$"), F.lit(1))
    good = F.filter(blocks, lambda b: F.get_json_object(b, "$.status").isNotNull())
    last = messages.withColumn("report", F.try_element_at(good, F.lit(-1))).filter("report IS NOT NULL")
    field = lambda name: F.get_json_object("report", f"$.{name}")
    return last.select("event_uid", field("status").alias("status"), F.coalesce(field("task_id"), field("task")).alias("task_id"), field("version").try_cast("int").alias("version"), "report")
