"""Links between sessions and spawns on rows written here, and runs' parsers."""

import datetime as dt
import random

from pyspark.sql import functions as F

from loomlog.operators import links
from loomlog.plans import loops, upkeep

SESSIONS = [
    # id, agent, session_uid, agent_id, parent_session_uid, root_session_uid, is_subagent, agent_path
    (1, "claude", "c", "", None, None, False, None),
    (2, "claude", "c", "a1", None, None, True, None),
    (3, "codex", "x", "", None, "x", False, None),
    (4, "codex", "y", "", "x", "x", True, "root/team/fix"),
    (5, "codex", "z", "", "x", "x", True, "root/other/fix"),
    (6, "codex", "w", "", "x", "x", True, "root/solo"),
    (7, "pi", "p", "", None, None, False, None),
    (8, "pi", "q", "", None, None, True, "p/run-0"),
]
FIELDS = "id int, agent string, session_uid string, agent_id string, parent_session_uid string, root_session_uid string, is_subagent boolean, agent_path string"


def test_parents_roots_and_children(spark):
    linked = links.parents_and_roots(spark.createDataFrame(SESSIONS, FIELDS))
    got = {r.id: (r.parent_id, r.root_id) for r in linked.collect()}
    assert got == {1: (None, 1), 2: (1, 1), 3: (None, 3), 4: (3, 3), 5: (3, 3), 6: (3, 3), 7: (None, 7), 8: (None, None)}
    linked = linked.withColumn("parent_id", F.when(F.col("id") == 8, 7).otherwise(F.col("parent_id")))
    spawns = [("s1", "claude", 1, "c", "a1", None), ("s2", "codex", 3, "y", None, None), ("s3", "codex", 3, None, None, "solo"), ("s4", "codex", 3, None, None, "fix"), ("s5", "pi", 7, None, None, "run-0"), ("s6", "pi", 7, None, None, "run-1")]
    spawns = spark.createDataFrame(spawns, "spawn_uid string, agent string, parent_id int, child_session_uid string, child_agent_id string, child_task_name string")
    found = {r.spawn_uid: r.child_id for r in links.spawned_children(spawns, linked).collect()}
    assert found == {"s1": 2, "s2": 4, "s3": 6, "s4": None, "s5": 8, "s6": None}  # two paths end with /fix


def test_evidence(spark):
    evidence = spark.createDataFrame([("r1", "a", "t"), ("r1", "b", "t"), ("r2", "a", "t"), ("r2", "c", "t"), ("r3", "c", "t"), ("r3", "d", "u")], "run_id string, response_id string, agent_type string")
    calls = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("d", 2)], "response_id string, session_id int")
    assert [(r.run_id, r.session_id) for r in links.by_response(evidence, calls).collect()] == [("r1", 1)]
    t = lambda h: dt.datetime(2026, 1, 1, h)
    spawns = [(1, "x", t(1)), (1, "x", t(5)), (2, "x", t(1)), (2, "y", t(5)), (3, "x", t(1)), (3, "y", t(2)), (4, None, t(1))]
    spawns = spark.createDataFrame(spawns, "child_id int, requested_type string, spawned_at timestamp")
    sessions = spark.createDataFrame([(i, t(3)) for i in range(1, 5)], "id int, first_ts timestamp")
    assert {r.child_id: r.agent_type for r in links.agreed_types(spawns, sessions).collect()} == {1: "x", 2: "x"}


def test_path_ends(spark):
    left = spark.createDataFrame([(1, "a/b/c"), (2, "/c"), (3, "c"), (4, "xb/c"), (5, None)], "id int, path string")
    right = spark.createDataFrame([("c",), ("b/c",), (None,)], "name string")
    got = sorted((r.id, r.name) for r in links.ending_with(left, right, "path", "name").collect())
    assert got == [(1, "b/c"), (1, "c"), (2, "c"), (4, "c")]


def test_briefs_and_garbage(spark):
    brief = lambda t: spark.range(1).select(loops.lane_brief_task(F.lit(t)).alias("b")).first().b
    assert tuple(brief("Lane: a · Task: K-1.2 (do (it)) · Tier: guarded\r\nmore")) == ("K-1.2", "do (it)")
    assert brief("Lane: a · Task: K-1 (x) · Tier: odd") is None and brief(" Lane: a · Task: K-1 (x) · Tier: routine") is None
    assert brief("Lane: a · Task: K-1 (" + "x" * 501 + ") · Tier: routine") is None
    stored = spark.createDataFrame([("m", 1, dt.datetime(2026, 1, 1))], "model string, input_sha int, created_at timestamp")
    none = stored.select("model", "input_sha").limit(0)
    count = lambda **k: upkeep.garbage(stored, none, "2026-03-01", 30, **k).count()
    assert count(chunks_reset="2026-01-01") == 1
    assert count() == count(chunks_reset="2026-01-01", backlog=True) == count(chunks_reset="2026-02-27") == 0


def test_started_inside_against_a_plain_search(spark):
    """Intervals of all lengths (none, microseconds, days, backward), equal times, folders above; and as many rows as go in, not pairs."""
    r = random.Random(11)
    t0 = dt.datetime(2026, 1, 1)
    at = lambda: t0 + dt.timedelta(microseconds=r.choice([r.randrange(50), r.randrange(10**4), r.randrange(10**8), r.randrange(3 * 10**11)]))
    paths = ["/a", "/a/b", "/a/b/c", "/ab", "a//x", "a/", "", None]
    children = [(i, at(), r.choice(paths)) for i in range(300)] + [(900, None, "/a")]
    intervals = [(i, b, b + dt.timedelta(microseconds=r.choice([-5, 0, 1, 3, 4, 17, 900, 10**5, 10**7, 10**9, 10**11])), r.choice([*paths, "a"])) for i in range(400) for b in [at()]] + [(901, t0, None, "/a")]
    intervals += [(1000 + i, c[1], c[1] + dt.timedelta(seconds=i), c[2]) for i, c in enumerate(children[:20])]
    given = spark.createDataFrame(children, "id int, s timestamp, p string"), spark.createDataFrame(intervals, "n int, b timestamp, e timestamp, f string")
    found = links.started_inside(*given, "s", "b", "e", "p", "f", "n")
    want = {}
    for id, s, p in children:
        inside = [(b, n) for n, b, e, f in intervals if None not in (s, p, e, f) and b <= s <= e and (p == f or p.startswith(f + "/"))]
        if inside:
            want[id] = max(inside)[1]
    assert {x.id: x.hit.n for x in found.collect()} == want and len(want) > 100
    many = spark.range(3000).select((F.col("id") * 0).cast("timestamp").alias("b"), F.timestamp_seconds(F.col("id") * 0 + 60).alias("e"), F.concat(F.lit("/a"), F.col("id") % 1).alias("f"), F.col("id").alias("n"))
    born = spark.range(3000).select("id", F.timestamp_micros(F.col("id") * 1000).alias("s"), F.concat(F.lit("/a"), F.col("id") % 1).alias("p"))
    plan = links.started_inside(born, many, "s", "b", "e", "p", "f", "n")
    assert {x.hit.n for x in plan.collect()} == {2999}
    joins = [line for line in plan._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in line]
    assert len(joins) == 1 and "[_folder#" in joins[0] and "_slot" not in joins[0]  # the only join tells a folder's levels
