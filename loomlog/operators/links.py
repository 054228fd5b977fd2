"""Joins by paths, positions and intervals, and the links between sessions that they give.

Pattern joins are equi-joins on what the pattern fixes: the ends of a path, a file and a byte, a slot of time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import lineage


def path_ends(path: Column) -> Column:
    """Every end of a path after one of its slashes, the shortest last."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "/"))).otherwise(F.array().cast("array<string>"))


def ending_with(left: DataFrame, right: DataFrame, path: str, name: str, on: tuple[str, ...] = ()) -> DataFrame:
    """Rows of both sides where the path ends with a slash and the name (and the columns `on` agree).

    A path has as many ends as slashes, so the pattern becomes an equality on the ends, without a nested loop.
    """
    ends = left.withColumn("_end", F.explode(path_ends(F.col(path))))
    return ends.join(right.withColumn("_end", F.col(name)), [*on, "_end"]).drop("_end")


def only_ending_with(left: DataFrame, right: DataFrame, path: str, name: str, id: str, found: str, on: tuple[str, ...] = ()) -> DataFrame:
    """(id, found) for the left ids whose matches by path end name a single value of found."""
    return lineage.unambiguous(ending_with(left, right, path, name, on).select(id, found), id, found)


def at_position(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that stand at the same place of a log: equal path and byte offset."""
    return left.join(right, ["path", "byte_offset"])


def _folders(path: Column) -> Column:
    """The path and every folder above it: what stands before each of its slashes."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def started_inside(children: DataFrame, intervals: DataFrame, start: str, begin: str, end: str, child_path: str, path: str, tie: str) -> DataFrame:
    """Each child row with the interval (struct hit) in which it starts and in whose folder it works; of several the latest.

    Children and intervals meet on folders (the child's is the interval's or lies below it) and slots of time, 4^level microseconds long, where
    the level goes by what the interval lasts, so that it touches 2 to 5 slots. Of those that fill a slot only the latest counts; of those
    that begin in it, the latest begun before the child; of those that end in it, the latest that ends after the child. So no pairs are made.
    """
    lasts = F.unix_micros(end) - F.unix_micros(begin)
    new = F.struct(F.struct(F.col(begin).alias("begin"), F.col(tie).alias("tie")).alias("order"), F.struct(*intervals.columns).alias("hit"))
    spans = intervals.filter((lasts >= 0) & F.col(path).isNotNull()).select(
        F.col(path).alias("_folder"), F.floor((F.length(F.bin(lasts)) - 1) / 2).cast("int").alias("_level"), F.unix_micros(begin).alias("_from"), F.unix_micros(end).alias("_to"), new.alias("_new")
    )
    slot = lambda at: F.expr(f"shiftright({at}, 2 * _level)")
    place, latest = ["_folder", "_level", "_slot"], F.max_by("_new", "_new.order")
    touched = spans.withColumns({"_first": slot("_from"), "_last": slot("_to")}).withColumn("_slot", F.explode(F.sequence("_first", "_last")))
    begins, ends = ((F.col("_level") > 0) & (F.col("_slot") == F.col(c)) for c in ("_first", "_last"))
    nothing = F.lit(None).cast(spans.schema["_new"].dataType)
    edges = touched.filter(begins | ends).select(*place, F.when(begins, F.col("_from")).otherwise(F.col("_to")).alias("_at"), F.when(begins, F.col("_new")).alias("_soon"), F.when(ends, F.col("_new")).alias("_late"))
    filled = touched.filter(~(begins | ends)).groupBy(*place).agg(latest.alias("_soon")).select(*place, F.lit(-(2**63)).alias("_at"), "_soon", nothing.alias("_late"))
    # a child looks at the levels that the intervals of a folder have
    own = children.select(F.struct(*children.columns).alias("_child"), F.unix_micros(start).alias("_at"), F.explode(_folders(F.col(child_path))).alias("_folder")).filter("_at IS NOT NULL")
    asked = own.join(spans.select("_folder", "_level").distinct(), "_folder").select(*place[:2], slot("_at").alias("_slot"), "_at", nothing.alias("_soon"), nothing.alias("_late"), "_child")
    met = asked.unionByName(edges, allowMissingColumns=True).unionByName(filled, allowMissingColumns=True)
    last = lambda c, *order: F.max_by(c, f"{c}.order").over(Window.partitionBy(*place).orderBy(*order))  # noqa: E731  rows of one time see each other
    seen = met.withColumns({"_before": last("_soon", F.asc("_at")), "_after": last("_late", F.desc("_at"))}).filter("_child IS NOT NULL")
    found = seen.select("_child", F.explode(F.array("_before", "_after")).alias("_new")).filter("_new IS NOT NULL")
    return found.groupBy("_child").agg(latest.alias("_new")).select("_child.*", F.col("_new.hit").alias("hit"))


def parents_and_roots(sessions: DataFrame) -> DataFrame:
    """sessions with parent_id and root_id.

    sessions: id, agent, session_uid, agent_id ('' for a main session), parent_session_uid, root_session_uid, is_subagent.
    claude: an agent's root and, unless another is known, its parent is the main session of its uid. codex: parent and root by
    the uids that the thread names. A session that is no subagent and names no parent or other root is its own root.
    """
    main = sessions.filter("agent_id = ''").select(F.col("agent").alias("_agent"), F.col("session_uid").alias("_uid"), F.col("id").alias("_id"))
    claude_child = (F.col("agent") == "claude") & (F.col("agent_id") != "")
    codex = F.col("agent") == "codex"
    out = sessions
    for name, uid, when in (
        ("_main", F.col("session_uid"), claude_child),
        ("_parent", F.col("parent_session_uid"), codex),
        ("_root", F.col("root_session_uid"), codex & (F.col("root_session_uid") != F.col("session_uid"))),
    ):
        right = main.select(F.col("_agent").alias("_a"), F.col("_uid").alias("_u"), F.col("_id").alias(name))
        out = out.join(right, (F.col("agent") == F.col("_a")) & (uid == F.col("_u")) & when, "left").drop("_a", "_u")
    own = ~F.col("is_subagent") & F.col("parent_session_uid").isNull() & (F.col("root_session_uid").isNull() | (F.col("root_session_uid") == F.col("session_uid")))
    return out.withColumns({"parent_id": F.coalesce("_parent", "_main"), "root_id": F.coalesce("_main", "_root", F.when(own, F.col("id")))}).drop("_main", "_parent", "_root")


def spawned_children(spawns: DataFrame, linked: DataFrame) -> DataFrame:
    """spawns with child_id: by exact id, else by the tail of the child's path below its parent.

    spawns: spawn_uid, agent, parent_id, child_session_uid, child_agent_id, child_task_name. linked: parents_and_roots with
    agent_path. A claude child is found by uid and agent id, a codex child by uid or, if that is unknown, by a path that ends
    with the task's name; a pi child's path is its parent's and the task's name. What fits several children has none.
    """
    child = linked.select(F.col("id").alias("_id"), F.col("agent").alias("_agent"), F.col("session_uid").alias("_uid"), F.col("agent_id").alias("_aid"), F.col("parent_id").alias("_parent"), F.col("agent_path").alias("_path"))
    exact = F.when(F.col("agent") == "claude", F.col("child_agent_id")).when(F.col("agent") == "codex", F.lit(""))
    by_id = spawns.withColumn("_aid", exact).join(child, (F.col("agent") == F.col("_agent")) & (F.col("child_session_uid") == F.col("_uid")) & (spawns["agent"].isin("claude", "codex")) & (exact == child["_aid"])).select("spawn_uid", F.col("_id").alias("child_id"))
    tails = child.filter("_agent = 'codex'").select("_id", "_path", F.col("_parent").alias("parent_id"))
    named = spawns.filter("agent = 'codex' AND child_session_uid IS NULL AND child_task_name IS NOT NULL")
    by_tail = only_ending_with(tails, named.select("parent_id", "spawn_uid", "child_task_name"), "_path", "child_task_name", "spawn_uid", "_id", ("parent_id",)).withColumnRenamed("_id", "child_id")
    parent = linked.select(F.col("id").alias("parent_id"), F.coalesce("agent_path", "session_uid").alias("_base"))
    full = spawns.filter("agent = 'pi' AND child_task_name IS NOT NULL").join(parent, "parent_id").withColumn("_path", F.concat("_base", F.lit("/"), "child_task_name"))
    by_path = lineage.unambiguous(full.join(child.filter("_agent = 'pi'").select("_path", F.col("_parent").alias("parent_id"), F.col("_id").alias("child_id")), ["parent_id", "_path"]).select("spawn_uid", "child_id"), "spawn_uid", "child_id")
    found = lineage.unambiguous(by_id, "spawn_uid", "child_id").unionByName(by_tail).unionByName(by_path)
    return spawns.join(found, "spawn_uid", "left")


def by_response(evidence: DataFrame, calls: DataFrame) -> DataFrame:
    """(run_id, session_id, agent_type) for the runs whose responses (run_id, response_id, agent_type) all belong to one session
    and whose types don't differ; calls: response_id, session_id."""
    met = evidence.join(calls.select("response_id", "session_id"), "response_id").groupBy("run_id")
    one = met.agg(F.min("session_id").alias("session_id"), F.max("session_id").alias("_last"), F.min("agent_type").alias("agent_type"), F.max("agent_type").alias("_type"))
    return one.filter((F.col("session_id") == F.col("_last")) & (F.col("agent_type").eqNullSafe(F.col("_type")))).select("run_id", "session_id", "agent_type")


def agreed_types(spawns: DataFrame, sessions: DataFrame) -> DataFrame:
    """(child_id, agent_type): what all spawns of a child ask for, else what the only spawn before its first event asks for.

    spawns: child_id, requested_type, spawned_at; sessions: id, first_ts.
    """
    known = spawns.filter("child_id IS NOT NULL")
    asked = known.join(sessions.select(F.col("id").alias("child_id"), "first_ts"), "child_id").withColumn("_early", F.coalesce(F.col("spawned_at") <= F.col("first_ts"), F.lit(False)))
    early = lambda c: F.when(F.col("_early"), c)
    one = asked.groupBy("child_id").agg(
        F.when((F.count("requested_type") == F.count("*")) & (F.min("requested_type") == F.max("requested_type")), F.min("requested_type")).alias("all"),
        F.when(F.count_if("_early") == 1, F.min(early(F.col("requested_type")))).alias("first"),
    )
    return one.select("child_id", F.coalesce("all", "first").alias("agent_type")).filter("agent_type IS NOT NULL")
