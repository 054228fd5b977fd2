"""Where commits, denials and rules come from: views over git history, session events and installed features."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.functions import names
from loomlog.operators import search, temporal

#: Seconds between an agent's commit event and a commit that it may have made.
NEAR = 900
#: Parts of the paths of files that hold rules.
POLICY_FOLDERS, POLICY_FILES = ("/rules/", "/reference/"), ("SKILL.md", "AGENTS.md", "CLAUDE.md")
#: Phrases and a word of messages that may hold a lesson.
LESSON_PHRASES, LESSON_WORDS = ("turns out", "root cause", "was wrong", "the real", "instead of"), ("actually",)


def commit_events(git_events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Commits, picks, pushes and pull requests with their session."""
    return git_events.filter(F.col("op").isin("commit", "cherry_pick", "push", "pr")).join(sessions, ["agent", "session_uid"])


def _prefix_of(sha: Column, prefix: str) -> Column:
    """Whether one of both begins with the other. The first test reaches the scan."""
    return sha.startswith(prefix) | (F.lit(prefix).startswith(sha) & (F.length(sha) >= 7))


def why(sha_prefix: str, git_events: DataFrame, sessions: DataFrame, messages: DataFrame, commits: DataFrame, ci_runs: DataFrame, limit: int = 20) -> DataFrame:
    """Why a commit was made: (kind, ts, session_uid, sha, detail) rows of five kinds.

    agent_commit: events of the sha, the latest 20; prompt: the last prompt before each in its session, else in its root's;
    brief: the first brief of a subagent that committed; git_commit: the history's rows, with whether an event is near;
    ci: the latest run of each workflow of these commits. git_events: event_uid, agent, session_uid, ts, op, branch, sha_short;
    sessions: agent, session_uid, root_uid, is_subagent; messages: session_uid, ts, message_class, text, event_uid; commits: sha,
    repo_slug, committed_at, subject, insertions, deletions, files_changed, on_default, reverts_sha; ci_runs: run_id, head_sha,
    workflow, created_at, status, conclusion, attempt.
    """
    prefix = sha_prefix.strip().lower()
    if not re.fullmatch("[0-9a-f]{7,40}", prefix):
        raise ValueError("a prefix of 7 to 40 hexadecimal digits is needed")
    text = lambda *parts: F.concat_ws(" ", *parts)
    made = git_events.filter(F.col("op").isin("commit", "cherry_pick") & (F.length("sha_short") >= 7) & _prefix_of(F.lower("sha_short"), prefix))
    events = made.orderBy(F.desc("ts"), "event_uid").limit(limit).join(sessions, ["agent", "session_uid"]).select("event_uid", "ts", "session_uid", "root_uid", "is_subagent", F.lower("sha_short").alias("sha"), "op", "branch")
    found = commits.filter(F.col("sha").startswith(prefix)).orderBy(F.desc("committed_at"), "sha").limit(limit)
    # at most `limit` rows on either side, so these joins are broadcasts of a proven size
    said = messages.filter(F.col("message_class").isin("human_prompt", "queued_prompt")).select("session_uid", F.col("ts").alias("said_at"), F.col("text").alias("said"), F.col("event_uid").alias("said_uid"))
    own = events.withColumn("where", F.explode(F.array(F.struct(F.lit(0).alias("rank"), F.col("session_uid").alias("uid")), F.struct(F.lit(1).alias("rank"), F.col("root_uid").alias("uid")))))
    before = said.join(F.broadcast(own.select("event_uid", "ts", "sha", F.col("session_uid").alias("by"), F.col("where.rank").alias("rank"), F.col("where.uid").alias("session_uid"))), "session_uid").filter("said_at <= ts")
    last = before.groupBy("event_uid", "sha").agg(F.min_by(F.struct("said_at", "session_uid", "said"), F.struct("rank", -F.unix_micros("said_at"), "said_uid")).alias("p"))
    briefs = messages.filter("message_class = 'subagent_brief'").select("session_uid", F.col("ts").alias("said_at"), F.col("text").alias("said"), F.col("event_uid").alias("said_uid"))
    brief = briefs.join(F.broadcast(events.filter("is_subagent")), "session_uid").groupBy("event_uid", "sha", "session_uid").agg(F.min_by(F.struct("said_at", "said"), F.struct("said_at", "said_uid")).alias("p"))
    near = found.join(F.broadcast(events.select(F.col("ts").alias("_at"))), F.abs(F.unix_micros("committed_at") - F.unix_micros("_at")) <= NEAR * 1_000_000, "left_semi").select(F.col("sha").alias("_near"))
    undone = commits.filter("reverts_sha IS NOT NULL").join(F.broadcast(found.select(F.col("sha").alias("reverts_sha"))), "reverts_sha").select(F.col("reverts_sha").alias("_undone")).distinct()
    told = found.join(F.broadcast(near.distinct()), F.col("sha") == F.col("_near"), "left").join(F.broadcast(undone), F.col("sha") == F.col("_undone"), "left")
    runs = ci_runs.join(F.broadcast(found.select(F.col("sha").alias("head_sha"))), "head_sha", "left_semi")
    latest = temporal.latest_per_key(runs, ["head_sha", "workflow"], F.desc("created_at"), F.desc("run_id"))
    flag = lambda on, word: F.when(on, word)
    number = lambda c: F.col(c).cast("string")
    none = F.lit(None).cast("string")
    parts = [
        events.select(F.lit("agent_commit").alias("kind"), "ts", "session_uid", "sha", text("op", F.concat(F.lit("branch="), "branch"), flag(F.col("is_subagent"), "subagent")).alias("detail")),
        last.select(F.lit("prompt").alias("kind"), F.col("p.said_at").alias("ts"), F.col("p.session_uid").alias("session_uid"), "sha", F.left("p.said", F.lit(400)).alias("detail")),
        brief.select(F.lit("brief").alias("kind"), F.col("p.said_at").alias("ts"), "session_uid", "sha", F.left("p.said", F.lit(400)).alias("detail")),
        told.select(F.lit("git_commit").alias("kind"), F.col("committed_at").alias("ts"), none.alias("session_uid"), "sha", text(flag(F.col("_near").isNotNull(), "near_event"), flag(F.col("on_default"), "on_default"), F.concat(F.lit("+"), number("insertions"), F.lit(" -"), number("deletions")), F.concat(number("files_changed"), F.lit(" files")), flag(F.col("_undone").isNotNull(), "REVERTED")).alias("detail")),
        latest.select(F.lit("ci").alias("kind"), F.col("created_at").alias("ts"), none.alias("session_uid"), F.col("head_sha").alias("sha"), text("workflow", "status", "conclusion", F.concat(F.lit("attempt="), number("attempt")), F.concat(F.lit("run="), number("run_id"))).alias("detail")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def denials(events: DataFrame, tool_calls: DataFrame, log: DataFrame, since, limit: int | None = 300) -> DataFrame:
    """What was denied, by source, category and tool: events of transcripts (event_uid, session_uid, ts, kind, value, tool), whose
    call is named by the part of event_uid before ':denial', and a permission log (ts, tool_name, cmd_verb, reason). What costs
    the owner an action comes first, rules that work come last; a limit of None gives all rows."""
    cut = F.when(F.col("event_uid").endswith(":denial"), F.expr("left(event_uid, length(event_uid) - 7)"))
    told = events.filter((F.col("kind") == "denial") & (F.col("ts") >= F.lit(since))).withColumn("call_uid", cut)
    called = told.join(tool_calls.select("call_uid", "tool_name", "cmd_verb"), "call_uid", "left")
    category = F.when(F.col("value") == "permission-rule", "permission-rule (rules working)").otherwise(F.col("value"))
    ours = called.groupBy(category.alias("category"), F.coalesce("tool_name", "tool").alias("tool_name"), "cmd_verb").agg(F.count("*").alias("events"), F.countDistinct("session_uid").alias("sessions"), F.max("ts").alias("last_ts"))
    logged = log.filter(F.col("ts") >= F.lit(since)).groupBy("tool_name", "cmd_verb", "reason").agg(F.count("*").alias("events"), F.max("ts").alias("last_ts"))
    both = ours.select(F.lit("transcript").alias("source"), "*").unionByName(logged.select(F.lit("permission_log").alias("source"), F.lit("prompt-log").alias("category"), "*"), allowMissingColumns=True)
    rank = F.when(F.col("category") == "user-rejected", 0).when(F.col("category") == "automode-blocked", 1).when(F.col("category") == "prompt-log", 2).when(F.col("category") == "permission-rule (rules working)", 9).otherwise(5)
    ordered = both.withColumn("urgency", rank)
    return ordered if limit is None else ordered.orderBy("urgency", F.desc("events"), *[F.asc_nulls_last(c) for c in ("source", "category", "tool_name", "cmd_verb", "reason")]).limit(limit)


def policy_changes(files: DataFrame, commits: DataFrame, since, path_like: str | None = None, limit: int | None = 1000) -> DataFrame:
    """Commits that changed files of rules (repo_slug, sha, path, change), newest first; a pattern takes the place of the usual paths."""
    path = F.col("path")
    usual = F.lit(False)
    for part in POLICY_FOLDERS:
        usual = usual | path.contains(part)
    for end in POLICY_FILES:
        usual = usual | path.endswith(end)
    chosen = files.filter(path.like(path_like) if path_like is not None else usual)
    out = chosen.join(commits.filter(F.col("committed_at") >= F.lit(since)), ["repo_slug", "sha"])
    return out if limit is None else out.orderBy(F.desc("committed_at"), "sha", "path").limit(limit)


def host_key(target: Column) -> Column:
    """The first label of a host name in lower case; addresses stay whole. Null where a shell variable is left in it."""
    whole = target.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$") | target.contains(":")
    return F.when(~target.rlike("[$`]"), F.lower(F.when(whole, target).otherwise(F.substring_index(target, ".", 1))))


def infra_actions(tool_calls: DataFrame, host: str | None = None, around=None, hours: float = 2) -> DataFrame:
    """Calls on other machines (target_host), with host; those of one host around a time, if asked for."""
    out = tool_calls.withColumn("host", host_key(F.col("target_host"))).filter("host IS NOT NULL")
    if host is not None:
        out = out.filter(F.col("host") == host)
    if around is not None:
        out = out.filter(F.abs(F.unix_micros("ts") - F.unix_micros(F.lit(around).cast("timestamp"))) <= int(hours * 3_600_000_000))
    return out


def feature_uses(uses: DataFrame, features: DataFrame) -> DataFrame:
    """features (namespace, kind, name) with uses and last_ts, matched by key.

    uses: namespace, kind, name, ts. A skill is used under its own key or that of the part after the colon, and, if its name has
    no colon, under any key that ends with _ and it. A plugin is used under its name before the @, by skills that begin with it and
    by servers plugin_<it>_...; a server under its key or plugin_..._<key>. Each rule becomes an equality: what a use may stand
    for is listed, and so is what a feature answers to.
    """
    key = names.feature_key
    used = uses.groupBy("namespace", "kind", key(F.col("name")).alias("key")).agg(F.count("*").alias("uses"), F.max("ts").alias("last_ts"))
    parts = F.split("key", "_")
    n = F.size(parts)
    tails = F.transform(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), lambda i: F.array_join(F.slice(parts, i, F.greatest(n - i + 1, F.lit(0))), "_"))
    heads = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "_"))
    tagged = lambda tag, values: F.transform(values, lambda v: F.concat(F.lit(tag), v))
    several = n > 1
    none = F.array().cast("array<string>")
    # plugin_<a>_<rest>: a may itself hold underscores
    inner = F.when(F.col("key").startswith("plugin_") & (n > 2), F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.array_join(F.slice(parts, 2, i), "_"))).otherwise(none)
    outer = F.when(F.col("key").startswith("plugin_") & (n > 2), F.transform(F.sequence(F.lit(3), F.greatest(n, F.lit(3))), lambda i: F.array_join(F.slice(parts, i, F.greatest(n - i + 1, F.lit(0))), "_"))).otherwise(none)
    self = F.array("key")
    stands = (
        F.when(F.col("kind") == "skill", F.concat(tagged("skill=", self), F.when(several, tagged("skill~", tails)).otherwise(none), F.when(several, tagged("plugin<", heads)).otherwise(none)))
        .when(F.col("kind") == "plugin", tagged("plugin=", self))
        .otherwise(F.concat(tagged("server=", self), tagged("plugin>", inner), tagged("server~", outer)))
    )
    name = F.col("name")
    bare, base = key(F.regexp_replace(name, "^.*:", "")), key(F.substring_index(name, "@", 1))
    answers = (
        F.when(F.col("kind") == "skill", F.concat(tagged("skill=", F.array(key(name), bare)), F.when(~name.contains(":"), tagged("skill~", F.array(key(name)))).otherwise(none)))
        .when(F.col("kind") == "plugin", F.concat(tagged("plugin=", F.array(base)), tagged("plugin<", F.array(base)), tagged("plugin>", F.array(base))))
        .otherwise(F.concat(tagged("server=", F.array(key(name))), tagged("server~", F.array(bare))))
    )
    left = features.select("namespace", "kind", "name", F.explode(F.array_distinct(answers)).alias("tag"))
    right = used.select("namespace", F.concat_ws("/", "kind", "key").alias("use"), "uses", "last_ts", F.explode(F.array_distinct(stands)).alias("tag"))
    met = left.join(right, ["namespace", "tag"]).select("namespace", "kind", "name", "use", "uses", "last_ts").distinct()
    total = met.groupBy("namespace", "kind", "name").agg(F.sum("uses").alias("uses"), F.max("last_ts").alias("last_ts"))
    return features.join(total, ["namespace", "kind", "name"], "left").withColumn("uses", F.coalesce("uses", F.lit(0)))


def feature_status(features: DataFrame, now, days: int = 14) -> DataFrame:
    """features with uses as used, unknown (uses leave no trace), new or unused."""
    fresh = F.unix_micros(F.col("first_seen_at")) >= F.unix_micros(F.lit(now).cast("timestamp")) - days * 86_400_000_000
    untold = (F.col("namespace").startswith("codex-") & F.col("kind").isin("skill", "plugin")) | ((F.col("kind") == "mcp_server") & names.feature_key(F.col("name")).startswith("claude_ai_"))
    return features.withColumn("status", F.when(F.col("uses") > 0, "used").when(untold, "unknown").when(F.coalesce(fresh, F.lit(False)), "new").otherwise("unused"))


def lesson_candidates(messages: DataFrame, corrections: DataFrame, id: str, text: str, session: str, limit: int = 50, phrases: Sequence[str] = LESSON_PHRASES, words: Sequence[str] = LESSON_WORDS) -> DataFrame:
    """Messages with a phrase of correction, by BM25 of all phrases' words plus ln(1 + the session's corrections).

    corrections: session and n. Of three times the limit by text alone, the limit by the raised score (a report).
    """
    tokens = F.concat(F.lit(" "), F.array_join(search.plain_tokens(F.col(text)), " "), F.lit(" "))
    said = F.lit(False)
    for p in (*phrases, *words):
        said = said | F.contains(tokens, F.lit(f" {p} "))
    # the index counts all messages, the phrase test only chooses among them
    query = messages.sparkSession.createDataFrame([(1, " ".join((*phrases, *words)))], "query_id int, query string")
    scores = search.bm25(messages, id, text, query).drop("query_id")
    head = messages.filter(said).join(scores, id).orderBy(F.desc(F.round("score", 9)), id).limit(3 * limit)
    raised = head.join(corrections.select(session, F.col("n").alias("_n")), session, "left").withColumn("corrections", F.coalesce("_n", F.lit(0))).drop("_n")
    return raised.withColumn("score", F.col("score") + F.log(1 + F.col("corrections"))).orderBy(F.desc(F.round("score", 9)), id).limit(limit)


def near_commits(events: DataFrame, commits: DataFrame, seconds: int = NEAR) -> DataFrame:
    """(event_uid, sha): the commit that an event's short sha begins, at most so many seconds away, if it is one; the nearest of
    several. Prefixes of seven characters meet, then time decides."""
    left = events.filter(F.length("sha_short") >= 7).select("event_uid", "ts", F.lower("sha_short").alias("short"), F.left(F.lower("sha_short"), F.lit(7)).alias("p"))
    right = commits.select("sha", "committed_at", F.left("sha", F.lit(7)).alias("p"))
    apart = F.abs(F.unix_micros("ts") - F.unix_micros("committed_at"))
    met = left.join(right, "p").filter(F.col("sha").startswith(F.col("short")) & (apart <= seconds * 1_000_000))
    return met.groupBy("event_uid").agg(F.min_by("sha", F.struct(apart, "sha")).alias("sha"))


