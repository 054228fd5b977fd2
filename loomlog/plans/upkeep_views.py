"""Provenance, links, upkeep and runs over the tables of loomlog.plans.staged, each query by the library's own function."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomlog.functions import classify, names, text
from loomlog.operators import links, search, vectors
from loomlog.operators.temporal import latest_per_key

from . import loops, metrics, provenance, sessions, upkeep
from .catalogue import query
from .staged import WITH, staged
from .texts import _TOKENS, QUERIES, _bm25_sql

NOW = "2024-01-25 00:00:00"
_NOW = f"TIMESTAMP '{NOW}'"
_s = lambda c: F.col(c).cast("string")
_k = lambda: F.regexp_extract("props", "([0-9]+)", 1).cast("long")
_of = lambda by, *values: F.get(F.array(*[F.lit(v) for v in values]), by.cast("int"))
_us = lambda c: F.unix_micros(F.col(c)).alias(c)

_GIT = f"""{WITH}, commits AS (SELECT md5('c' || event_id) AS sha, 'o/r' || (user_id % 6) AS repo_slug, ts AS committed_at, 'subject ' || k AS subject, k AS insertions, k % 9 AS deletions, k % 4 + 1 AS files_changed, k % 2 = 0 AS on_default, CASE WHEN k % 5 = 0 THEN md5('c' || (event_id - 7)) END AS reverts_sha FROM ev WHERE event_type = 'purchase'),
git_events AS (SELECT 'g' || event_id AS event_uid, agent, session_uid, ts - to_seconds(k * 20) AS ts, CASE k % 3 WHEN 0 THEN 'push' ELSE 'commit' END AS op, 'b' || (k % 3) AS branch, left(md5('c' || event_id), (7 + k % 4)::INTEGER) AS sha_short FROM ev WHERE event_type = 'purchase'),
ci_runs AS (SELECT event_id * 2 + a AS run_id, md5('c' || event_id) AS head_sha, 'w' || (a % 2) AS workflow, ts + to_hours(a) AS created_at, 'completed' AS status, CASE WHEN k % 2 = a THEN 'success' ELSE 'failure' END AS conclusion, a + 1 AS attempt FROM ev, (VALUES (0), (1), (2)) v(a) WHERE event_type = 'purchase')"""


def _git(t):
    """commits, git_events and ci_runs."""
    ev = t("events").filter("event_type = 'purchase'").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", _k().alias("k"))
    sha = lambda id: F.md5(F.concat(F.lit("c"), id.cast("string")))
    user, k = F.col("user_id"), F.col("k")
    commits = ev.select(sha(F.col("event_id")).alias("sha"), F.concat(F.lit("o/r"), (user % 6).cast("string")).alias("repo_slug"), F.col("ts").alias("committed_at"), F.concat(F.lit("subject "), k.cast("string")).alias("subject"), k.alias("insertions"), (k % 9).alias("deletions"), (k % 4 + 1).alias("files_changed"), (k % 2 == 0).alias("on_default"), F.when(k % 5 == 0, sha(F.col("event_id") - 7)).alias("reverts_sha"))
    events = ev.select(
        F.concat(F.lit("g"), _s("event_id")).alias("event_uid"), _of(user % 3, "claude", "codex", "pi").alias("agent"), F.concat(F.lit("u"), user.cast("string")).alias("session_uid"), F.timestamp_micros(F.unix_micros("ts") - k * 20_000_000).alias("ts"),
        F.when(k % 3 == 0, "push").otherwise("commit").alias("op"), F.concat(F.lit("b"), (k % 3).cast("string")).alias("branch"), F.left(sha(F.col("event_id")), (7 + k % 4).cast("int")).alias("sha_short"),
    )
    runs = ev.withColumn("a", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select((F.col("event_id") * 2 + F.col("a")).alias("run_id"), sha(F.col("event_id")).alias("head_sha"), F.concat(F.lit("w"), (F.col("a") % 2).cast("string")).alias("workflow"), F.timestamp_micros(F.unix_micros("ts") + F.col("a") * 3_600_000_000).alias("created_at"), F.lit("completed").alias("status"), F.when(k % 2 == F.col("a"), "success").otherwise("failure").alias("conclusion"), (F.col("a") + 1).alias("attempt"))
    return commits, events, runs


@query(
    "view_near_commits",
    f"""{_GIT} SELECT event_uid, arg_min(sha, (abs(epoch_us(g.ts) - epoch_us(committed_at)), sha)) AS sha FROM git_events g JOIN commits c ON starts_with(c.sha, g.sha_short) AND abs(epoch_us(g.ts) - epoch_us(committed_at)) <= 900000000 GROUP BY 1""",
)
def view_near_commits(t):
    """Which commit each event made: by the prefix of its hash and the time between them."""
    commits, events, _ = _git(t)
    return provenance.near_commits(events, commits)


@query("view_commit_events", f"{_GIT} SELECT event_uid, op, sha_short, cwd FROM git_events JOIN sessions USING (agent, session_uid)")
def view_commit_events(t):
    return provenance.commit_events(_git(t)[1], staged(t)["sessions"]).select("event_uid", "op", "sha_short", "cwd")


@query(
    "view_why_commit",
    f"""{_GIT}, p AS (SELECT left(min(sha), 7) AS p FROM commits), tree AS (SELECT session_uid, coalesce(parent_uid, session_uid) AS root_uid, parent_uid IS NOT NULL AS is_subagent FROM sessions),
    e AS (SELECT g.*, root_uid, is_subagent FROM git_events g JOIN tree USING (session_uid), p WHERE op = 'commit' AND (starts_with(sha_short, p) OR starts_with(p, sha_short)) ORDER BY ts DESC, event_uid LIMIT 20),
    c AS (SELECT commits.* FROM commits, p WHERE starts_with(sha, p) ORDER BY committed_at DESC, sha LIMIT 20),
    q AS (SELECT e.event_uid, e.sha_short, m.ts, m.session_uid, m.text, row_number() OVER (PARTITION BY e.event_uid ORDER BY m.session_uid <> e.session_uid, m.ts DESC, m.event_uid) AS n FROM e JOIN messages m ON m.session_uid IN (e.session_uid, e.root_uid) AND m.message_class = 'human_prompt' AND m.ts <= e.ts),
    b AS (SELECT e.event_uid, e.sha_short, e.session_uid, m.ts, m.text, row_number() OVER (PARTITION BY e.event_uid ORDER BY m.ts, m.event_uid) AS n FROM e JOIN messages m ON m.session_uid = e.session_uid AND m.message_class = 'injected' WHERE is_subagent),
    r AS (SELECT ci_runs.*, row_number() OVER (PARTITION BY head_sha, workflow ORDER BY created_at DESC, run_id DESC) AS n FROM ci_runs WHERE head_sha IN (SELECT sha FROM c))
    SELECT 'agent_commit' AS kind, epoch_us(ts) AS ts, session_uid, sha_short AS sha, concat_ws(' ', op, 'branch=' || branch, CASE WHEN is_subagent THEN 'subagent' END) AS detail FROM e
    UNION ALL SELECT 'prompt', epoch_us(ts), session_uid, sha_short, text FROM q WHERE n = 1 UNION ALL SELECT 'brief', epoch_us(ts), session_uid, sha_short, text FROM b WHERE n = 1
    UNION ALL SELECT 'git_commit', epoch_us(committed_at), NULL, sha, concat_ws(' ', CASE WHEN EXISTS (SELECT 1 FROM e WHERE abs(epoch_us(e.ts) - epoch_us(committed_at)) <= 900000000) THEN 'near_event' END, CASE WHEN on_default THEN 'on_default' END,
        '+' || insertions || ' -' || deletions, files_changed || ' files', CASE WHEN sha IN (SELECT reverts_sha FROM commits) THEN 'REVERTED' END) FROM c
    UNION ALL SELECT 'ci', epoch_us(created_at), NULL, head_sha, concat_ws(' ', workflow, status, conclusion, 'attempt=' || attempt, 'run=' || run_id) FROM r WHERE n = 1""",
)
def view_why_commit(t):
    """Everything that tells why one commit was made (at most twenty events and commits of a prefix)."""
    commits, events, runs = _git(t)
    s = staged(t)
    tree = s["sessions"].select("agent", "session_uid", F.coalesce("parent_uid", "session_uid").alias("root_uid"), F.col("parent_uid").isNotNull().alias("is_subagent"))
    messages = s["messages"].withColumn("message_class", F.when(F.col("message_class") == "injected", "subagent_brief").otherwise(F.col("message_class")))
    prefix = (commits.agg(F.min("sha")).first()[0] or "")[:7]
    return provenance.why(prefix, events, tree, messages, commits, runs).withColumn("ts", F.unix_micros("ts"))


@query(
    "view_denials",
    f"""{WITH}, told AS (SELECT tool_name, CASE byte_offset % 4 WHEN 0 THEN 'user-rejected' WHEN 1 THEN 'automode-blocked' WHEN 2 THEN 'permission-rule (rules working)' ELSE 'other' END AS category, 'v' || byte_offset % 3 AS cmd_verb, session_uid, ts FROM tool_calls WHERE ts >= TIMESTAMP '2024-01-10'),
    x AS (SELECT 'transcript' AS source, category, tool_name, cmd_verb, NULL AS reason, count(*) AS events, count(DISTINCT session_uid) AS sessions, epoch_us(max(ts)) AS last_ts FROM told GROUP BY category, tool_name, cmd_verb
        UNION ALL SELECT 'permission_log', 'prompt-log', 'Bash', 'v' || k % 3, CASE WHEN k % 2 = 0 THEN 'asked' END, count(*), NULL, epoch_us(max(ts)) FROM ev WHERE event_type = 'view' AND ts >= TIMESTAMP '2024-01-10' GROUP BY 4, 5)
    SELECT *, CASE category WHEN 'user-rejected' THEN 0 WHEN 'automode-blocked' THEN 1 WHEN 'prompt-log' THEN 2 WHEN 'permission-rule (rules working)' THEN 9 ELSE 5 END AS urgency FROM x""",
)
def view_denials(t):
    """Denials of transcripts and of the permission log, with their order of urgency."""
    n = F.col("byte_offset")
    calls = staged(t)["tool_calls"].withColumn("cmd_verb", F.concat(F.lit("v"), (n % 3).cast("string")))
    events = calls.select(F.concat("call_uid", F.lit(":denial")).alias("event_uid"), "session_uid", "ts", F.lit("denial").alias("kind"), _of(n % 4, "user-rejected", "automode-blocked", "permission-rule", "other").alias("value"), F.lit("?").alias("tool"))
    log = t("events").filter("event_type = 'view'").select(F.col("ts").cast("timestamp").alias("ts"), F.lit("Bash").alias("tool_name"), F.concat(F.lit("v"), (_k() % 3).cast("string")).alias("cmd_verb"), F.when(_k() % 2 == 0, "asked").alias("reason"))
    return provenance.denials(events, calls, log, "2024-01-10 00:00:00", None).withColumn("last_ts", F.unix_micros("last_ts"))


_PATHS = ("src/a.py", "x/rules/b.md", "docs/AGENTS.md", "y/reference/c", "SKILL.md.bak", "z/SKILL.md")


@query(
    "view_policy_changes",
    f"""{_GIT}, files AS (SELECT repo_slug, sha, [{", ".join(f"'{p}'" for p in _PATHS)}][insertions % 6 + 1] AS path, 'M' AS change FROM commits)
    SELECT sha, path, subject FROM files JOIN commits USING (repo_slug, sha) WHERE committed_at >= TIMESTAMP '2024-01-03' AND (path LIKE '%/rules/%' OR path LIKE '%/reference/%' OR path LIKE '%SKILL.md' OR path LIKE '%AGENTS.md' OR path LIKE '%CLAUDE.md')""",
)
def view_policy_changes(t):
    commits, _, _ = _git(t)
    files = commits.select("repo_slug", "sha", _of(F.col("insertions") % 6, *_PATHS).alias("path"), F.lit("M").alias("change"))
    return provenance.policy_changes(files, commits, "2024-01-03 00:00:00", limit=None).select("sha", "path", "subject")


_HOSTS = ("Build01.example.net", "10.0.0.1", "$HOST", "host1", "a`b", "FE80::1")
_TARGETS = ", ".join(f"'{h}'" for h in _HOSTS)


@query(
    "view_infra_actions",
    f"""{WITH}, c AS (SELECT call_uid, ts, [{_TARGETS}][byte_offset % 6 + 1] AS target_host FROM tool_calls), h AS (SELECT *, CASE WHEN regexp_matches(target_host, '^[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+$') OR target_host LIKE '%:%' THEN lower(target_host) ELSE lower(split_part(target_host, '.', 1)) END AS host FROM c WHERE NOT regexp_matches(target_host, '[$`]'))
    SELECT call_uid, target_host, host FROM h WHERE host IN ('build01', '10.0.0.1', 'host1', 'fe80::1') AND ts BETWEEN TIMESTAMP '2024-01-10' - INTERVAL 200 HOUR AND TIMESTAMP '2024-01-10' + INTERVAL 200 HOUR""",
)
def view_infra_actions(t):
    """Calls on other machines within hours of a time; hosts by their first label, shell variables left out."""
    calls = staged(t)["tool_calls"].withColumn("target_host", _of(F.col("byte_offset") % 6, *_HOSTS))
    return provenance.infra_actions(calls, around="2024-01-10 00:00:00", hours=200).select("call_uid", "target_host", "host")


_FEATURES = (("claude", "skill", "Fix-It"), ("claude", "skill", "pack:lint"), ("claude", "skill", "lint"), ("claude", "plugin", "pack@shop"), ("claude", "plugin", "other"), ("claude", "mcp_server", "pack:store"), ("claude", "mcp_server", "Claude AI mail"), ("codex", "skill", "lint"), ("pi", "mcp_server", "store"), ("pi", "skill", "never"))
_USES = (("skill", "fix-it"), ("skill", "pack:lint"), ("skill", "/lint"), ("plugin", "pack"), ("mcp_server", "plugin_pack_store"), ("mcp_server", "store"), ("skill", "pack_deep"), ("skill", "x_lint"))


@query(
    "view_feature_uses",
    f"""{WITH}, f(namespace, kind, name) AS (SELECT * FROM (VALUES {", ".join(str(x) for x in _FEATURES)}) v(a, b, c)), key AS (SELECT namespace, kind, name, regexp_replace(lower(ltrim(name, '/')), '[^a-z0-9-]+', '_', 'g') AS k, regexp_replace(lower(regexp_replace(name, '^.*:', '')), '[^a-z0-9-]+', '_', 'g') AS bare, regexp_replace(lower(split_part(name, '@', 1)), '[^a-z0-9-]+', '_', 'g') AS base FROM f),
    n(i, kind, name) AS (SELECT * FROM (VALUES {", ".join(str((i, *u)) for i, u in enumerate(_USES))}) v(a, b, c)), u AS (SELECT agent AS namespace, n.kind, regexp_replace(lower(ltrim(n.name, '/')), '[^a-z0-9-]+', '_', 'g') AS k, count(*) AS uses FROM ev JOIN n ON n.i = ev.k % 8 GROUP BY ALL)
    SELECT f.namespace, f.kind, f.name, coalesce(sum(u.uses), 0)::BIGINT AS uses, CASE WHEN coalesce(sum(u.uses), 0) > 0 THEN 'used' WHEN f.kind = 'mcp_server' AND f.k LIKE 'claude\\_ai\\_%' ESCAPE '\\' THEN 'unknown' ELSE 'unused' END AS status
    FROM key f LEFT JOIN u ON u.namespace = f.namespace AND (f.kind = 'skill' AND u.kind = 'skill' AND (u.k = f.k OR u.k = f.bare OR f.name NOT LIKE '%:%' AND ends_with(u.k, '_' || f.k))
        OR f.kind = 'plugin' AND (u.kind = 'plugin' AND u.k = f.base OR u.kind = 'skill' AND starts_with(u.k, f.base || '_') OR u.kind = 'mcp_server' AND starts_with(u.k, 'plugin_' || f.base || '_'))
        OR f.kind = 'mcp_server' AND u.kind = 'mcp_server' AND (u.k = f.k OR starts_with(u.k, 'plugin_') AND ends_with(u.k, '_' || f.bare))) GROUP BY f.namespace, f.kind, f.name, f.k""",
)
def view_feature_uses(t):
    """Installed features and what uses stand for them: the pattern rules as equalities."""
    spark = t("events").sparkSession
    features = spark.createDataFrame(_FEATURES, "namespace string, kind string, name string").withColumn("first_seen_at", F.lit("2020-01-01").cast("timestamp"))
    ev = t("events").select(_of(F.col("user_id") % 3, "claude", "codex", "pi").alias("namespace"), (_k() % 8).alias("i"), F.col("ts").cast("timestamp").alias("ts"))
    uses = ev.select("namespace", _of(F.col("i"), *[u[0] for u in _USES]).alias("kind"), _of(F.col("i"), *[u[1] for u in _USES]).alias("name"), "ts")
    return provenance.feature_status(provenance.feature_uses(uses, features), NOW).select("namespace", "kind", "name", "uses", "status")


@query(
    "view_lesson_candidates",
    rf"""WITH d AS (SELECT doc_id, source, {_TOKENS} AS ts FROM documents), s AS (SELECT count(*)::DOUBLE AS n, avg(len(ts)) AS m FROM d WHERE len(ts) > 0),
    p AS (SELECT doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM d) GROUP BY 1, 2), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
    b AS (SELECT doc_id, sum(ln(1 + (s.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * p.n / m))) AS score FROM (VALUES ('of'), ('the'), ('tion')) q(term) JOIN p USING (term) JOIN f USING (term), s GROUP BY 1),
    h AS (SELECT d.doc_id, d.source, b.score FROM b JOIN d USING (doc_id) WHERE contains(' ' || array_to_string(ts, ' ') || ' ', ' of the ') OR list_contains(ts, 'tion') ORDER BY round(b.score, 9) DESC, d.doc_id LIMIT 60),
    c AS (SELECT source, count(*) % 5 AS n FROM documents GROUP BY 1)
    SELECT doc_id, n AS corrections, round(score + ln(1 + n), 6) AS score FROM h JOIN c USING (source) ORDER BY round(h.score + ln(1 + n), 9) DESC, doc_id LIMIT 20""",
)
def view_lesson_candidates(t):
    """Texts with a phrase, ranked by words and by their source's corrections (a report of twenty)."""
    docs = t("documents")
    corrections = docs.groupBy("source").agg((F.count("*") % 5).alias("n"))
    found = provenance.lesson_candidates(docs, corrections, "doc_id", "text", "source", 20, ("of the",), ("tion",))
    return found.select("doc_id", "corrections", F.round("score", 6).alias("score"))


_SESSIONS = """WITH u AS (SELECT DISTINCT user_id AS id FROM events), s AS (SELECT id, ['claude', 'codex', 'pi'][id % 3 + 1] AS agent, id % 5 <> 0 AS is_subagent, CASE WHEN id % 3 = 0 AND id % 5 <> 0 THEN 'u' || (id // 15 * 15) ELSE 'u' || id END AS session_uid, CASE WHEN id % 3 = 0 AND id % 5 <> 0 THEN 'a' || id ELSE '' END AS agent_id,
    CASE WHEN id % 5 <> 0 THEN 'u' || (id - 3) END AS parent_session_uid, CASE WHEN id % 5 <> 0 THEN 'u' || (id % 10) END AS root_session_uid FROM u)"""


@query(
    "view_parents_and_roots",
    f"""{_SESSIONS}, m AS (SELECT * FROM s WHERE agent_id = '') SELECT s.id, coalesce(p.id, c.id) AS parent_id, coalesce(c.id, r.id, CASE WHEN NOT s.is_subagent THEN s.id END) AS root_id FROM s
    LEFT JOIN m c ON s.agent = 'claude' AND s.agent_id <> '' AND c.agent = 'claude' AND c.session_uid = s.session_uid LEFT JOIN m p ON s.agent = 'codex' AND p.agent = 'codex' AND p.session_uid = s.parent_session_uid
    LEFT JOIN m r ON s.agent = 'codex' AND r.agent = 'codex' AND r.session_uid = s.root_session_uid AND s.root_session_uid <> s.session_uid""",
)
def view_parents_and_roots(t):
    """Links between sessions by the ids that each harness gives."""
    id = F.col("id")
    u = lambda n: F.concat(F.lit("u"), n.cast("string"))
    sub, inner = id % 5 != 0, (id % 3 == 0) & (id % 5 != 0)
    made = t("events").select(F.col("user_id").alias("id")).distinct().select(
        "id", _of(id % 3, "claude", "codex", "pi").alias("agent"), sub.alias("is_subagent"), F.when(inner, u(F.floor(id / 15) * 15)).otherwise(u(id)).alias("session_uid"), F.when(inner, F.concat(F.lit("a"), _s("id"))).otherwise("").alias("agent_id"),
        F.when(sub, u(id - 3)).alias("parent_session_uid"), F.when(sub, u(id % 10)).alias("root_session_uid"),
    )
    return links.parents_and_roots(made).select("id", "parent_id", "root_id")


@query(
    "view_path_ends",
    """WITH n AS (SELECT page_id AS name_id, regexp_extract(url, '//(.*)$', 1) AS rest FROM pages), m AS (SELECT name_id, substr(rest, strpos(rest, '/') + 1) AS name FROM n)
    SELECT page_id, name_id FROM pages JOIN m ON ends_with(url, '/' || name)""",
)
def view_path_ends(t):
    """Which paths end with which names: a pattern join as an equality on the paths' ends."""
    rest = F.regexp_extract("url", "//(.*)$", 1)
    named = t("pages").select(F.col("page_id").alias("name_id"), F.substr(rest, F.locate("/", rest) + 1).alias("name"))
    return links.ending_with(t("pages").select("page_id", "url"), named, "url", "name").select("page_id", "name_id")


@query(
    "view_only_path_end",
    """WITH n AS (SELECT DISTINCT regexp_extract(url, '([^/]+)$', 1) AS name, regexp_extract(url, '/([a-z]{2})/', 1) AS lang FROM pages)
    SELECT name, min(page_id) AS page_id FROM (SELECT n.name, p.page_id FROM n JOIN pages p ON ends_with(p.url, '/' || n.name) AND regexp_extract(p.url, '/([a-z]{2})/', 1) = n.lang) GROUP BY 1 HAVING count(DISTINCT page_id) = 1""",
)
def view_only_path_end(t):
    """Names that a single path ends with, within a language."""
    lang = F.regexp_extract("url", "/([a-z]{2})/", 1).alias("lang")
    names = t("pages").select(F.regexp_extract("url", "([^/]+)$", 1).alias("name"), lang).distinct()
    return links.only_ending_with(t("pages").select("page_id", "url", lang), names, "url", "name", "name", "page_id", ("lang",))


@query(
    "view_started_inside",
    f"""{WITH}, i AS (SELECT call_uid, c.ts AS begin, c.ts + INTERVAL 5 HOUR AS stop, CASE WHEN byte_offset % 2 = 0 THEN cwd ELSE '/home/x/repos' END AS path FROM tool_calls c JOIN sessions USING (session_uid))
    SELECT s.session_uid, arg_max(call_uid, (begin, call_uid)) AS call_uid FROM sessions s JOIN i ON s.first_ts BETWEEN begin AND stop AND (s.cwd = i.path OR starts_with(s.cwd, i.path || '/')) GROUP BY 1""",
)
def view_started_inside(t):
    """Sessions that began while a command ran in their folder or above it: the latest such command."""
    s = staged(t)
    homes = s["sessions"].select("session_uid", "cwd")
    path = F.when(F.col("byte_offset") % 2 == 0, F.col("cwd")).otherwise("/home/x/repos")
    intervals = s["tool_calls"].join(homes, "session_uid").select("call_uid", F.col("ts").alias("begin"), F.timestamp_micros(F.unix_micros("ts") + 5 * 3_600_000_000).alias("stop"), path.alias("path"))
    found = links.started_inside(s["sessions"].select("session_uid", "first_ts", "cwd"), intervals, "first_ts", "begin", "stop", "cwd", "path", "call_uid")
    return found.select("session_uid", F.col("hit.call_uid").alias("call_uid"))


@query("view_at_position", f"{WITH} SELECT call_uid, event_id AS dispatch FROM tool_calls c JOIN ev USING (path, byte_offset)")
def view_at_position(t):
    """A call and what was dispatched at its place in the log."""
    dispatched = t("events").select(F.concat(F.lit("p"), (F.col("user_id") % 7).cast("string"), F.lit(".jsonl")).alias("path"), F.col("event_id").alias("byte_offset"), F.col("event_id").alias("dispatch"))
    return links.at_position(staged(t)["tool_calls"].select("call_uid", "path", "byte_offset"), dispatched).select("call_uid", "dispatch")


@query("view_visible_sessions", f"{WITH} SELECT session_uid FROM sessions WHERE NOT is_stub")
def view_visible_sessions(t):
    return upkeep.visible(staged(t)["sessions"]).select("session_uid")


@query("view_conversation_calls", f"{WITH} SELECT response_id FROM calls WHERE stop_reason NOT LIKE 'usage:%' AND stop_reason NOT IN ('compaction', 'branch_summary')")
def view_conversation_calls(t):
    return upkeep.conversation_calls(staged(t)["calls"]).select("response_id")


@query(
    "view_filled_usage",
    f"""{WITH}, c AS (SELECT response_id, byte_offset % 5 = 0 AND stop_reason = 'end' AS u, stop_reason, input_tokens, cached_tokens, output_tokens, byte_offset FROM calls)
    SELECT response_id, u AND byte_offset % 2 = 0 AS filled, CASE WHEN u THEN CASE WHEN byte_offset % 2 = 0 THEN 60 ELSE 0 END ELSE input_tokens END AS input_tokens, CASE WHEN u THEN CASE WHEN byte_offset % 2 = 0 THEN 30 END ELSE cached_tokens END AS cached_tokens,
    CASE WHEN u THEN CASE WHEN byte_offset % 2 = 0 THEN 7 ELSE 0 END ELSE output_tokens END AS output_tokens FROM c""",
)
def view_filled_usage(t):
    """Usage that the transcript doesn't tell, from a spend log; what is known stays."""
    untold = (F.col("byte_offset") % 5 == 0) & (F.col("stop_reason") == "end")
    calls = staged(t)["calls"].withColumns({"input_tokens": F.when(untold, 0).otherwise(F.col("input_tokens")), "cached_tokens": F.when(~untold, F.col("cached_tokens")), "cache_write_tokens": F.when(~untold, F.col("cache_write_tokens")), "output_tokens": F.when(untold, 0).otherwise(F.col("output_tokens")), "stop_reason": F.when(~untold, F.col("stop_reason"))})
    known = calls.withColumn("stop_reason", F.coalesce("stop_reason", F.when(~untold, "end")))
    spend = known.filter("byte_offset % 2 = 0").select(F.col("response_id").alias("request_id"), F.lit(100).alias("prompt_tokens"), F.lit(30).alias("cached"), F.lit(10).alias("written"), F.lit(7).alias("completion_tokens"))
    return upkeep.filled_usage(known, spend).select("response_id", "filled", "input_tokens", "cached_tokens", "output_tokens")


@query("view_seeded_prices", f"{WITH} SELECT model, effective_from, input FROM prices UNION ALL SELECT 'm' || i, '2024-01-05', 9.0 FROM range(6) r(i) WHERE i <> 1")
def view_seeded_prices(t):
    """List prices where the owner has none for that model and day."""
    prices = staged(t)["prices"]
    seed = prices.sparkSession.createDataFrame([(f"m{i}", 9.0, 9.0, 9.0, 9.0) for i in range(6)], "model string, input double, cached double, cache_write double, output double").withColumn("effective_from", F.lit("2024-01-05").cast("date"))
    return upkeep.seeded(prices, seed).select("model", _s("effective_from").alias("effective_from"), "input")


@query(
    "view_reconciled",
    """SELECT key, CASE WHEN o IS NOT NULL AND s IS NULL THEN 'insert' WHEN o IS NOT NULL AND NOT flag THEN 'restore' WHEN o IS NULL AND flag THEN 'demote' ELSE 'keep' END AS action FROM
    (SELECT coalesce(s.id, o.id) AS key, s.id AS s, o.id AS o, s.flag FROM (SELECT event_id AS id, user_id % 2 = 0 AS flag FROM events WHERE event_id % 3 <> 0) s FULL JOIN (SELECT event_id AS id FROM events WHERE event_id % 5 <> 0) o ON s.id = o.id)""",
)
def view_reconciled(t):
    """What a full observation does to what is stored."""
    e = t("events")
    stored = e.filter("event_id % 3 <> 0").select(F.col("event_id").alias("key"), (F.col("user_id") % 2 == 0).alias("on_branch"))
    return upkeep.reconciled(stored, e.filter("event_id % 5 <> 0").select(F.col("event_id").alias("key")), ["key"], "on_branch")


@query("view_availability", "SELECT page_id::VARCHAR AS path, CASE WHEN page_id % 7 = 0 THEN 'new' WHEN page_id % 2 = 0 THEN 'hot' WHEN page_id % 3 = 0 THEN 'cold' ELSE 'missing' END AS availability FROM pages WHERE page_id % 7 <> 0 OR page_id % 2 = 0 OR page_id % 3 = 0")
def view_availability(t):
    """Where catalogued sources can still be read."""
    p = t("pages").select("page_id", _s("page_id").alias("path"))
    return upkeep.availability(p.filter("page_id % 7 <> 0"), p.filter("page_id % 2 = 0"), p.filter("page_id % 3 = 0"))


@query(
    "view_embedding_work",
    """SELECT doc_id::VARCHAR AS event_uid FROM documents WHERE source IN ('src1', 'src2', 'src3', 'src4') AND (length(text) >= 30 OR octet_length(encode(text)) >= 120) AND NOT (doc_id % 4 = 0) AND NOT (doc_id % 5 = 0)""",
)
def view_embedding_work(t):
    """Texts without a chunk of their present content that haven't failed too often."""
    d = t("documents").select("doc_id", _s("doc_id").alias("event_uid"), F.md5("text").alias("content_sha"), F.col("source").alias("message_class"), "text")
    chunks = d.filter("doc_id % 4 = 0").select("event_uid", F.col("content_sha").alias("source_sha")).union(d.filter("doc_id % 7 = 0").select("event_uid", F.lit("stale")))
    failures = d.filter("doc_id % 5 = 0 OR doc_id % 3 = 0").select("event_uid", "content_sha", F.when(F.col("doc_id") % 5 == 0, 3).otherwise(2).alias("failures"))
    return upkeep.embedding_work(d, chunks, failures, ["src1", "src2", "src3", "src4"]).select("event_uid")


@query("view_vector_garbage", f"SELECT event_id AS input_sha FROM events WHERE ts < {_NOW} - INTERVAL 10 DAY AND user_id % 3 <> 0")
def view_vector_garbage(t):
    """Vectors that nothing refers to any more."""
    e = t("events").select(F.lit("m").alias("model"), F.col("event_id").alias("input_sha"), F.col("ts").cast("timestamp").alias("created_at"), "user_id")
    return upkeep.garbage(e, e.filter("user_id % 3 = 0").select("model", "input_sha"), NOW, 10, chunks_reset="2024-01-10 00:00:00").select("input_sha")


@query(
    "view_session_vectors",
    """WITH m AS (SELECT label, i, avg(e) AS x FROM (SELECT label, unnest(embedding::DOUBLE[]) AS e, unnest(range(1, 65)) AS i FROM embeddings WHERE label % 2 = 0) GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(x * x)) AS norm FROM m GROUP BY 1)
    SELECT label, i - 1 AS place, round(x / norm, 6) AS x FROM m JOIN n USING (label)""",
)
def view_session_vectors(t):
    """Mean vectors at unit length of the groups that changed."""
    e = t("embeddings")
    return upkeep.session_vectors(e, "label", "embedding", e.filter("label % 2 = 0").select("label")).select("label", F.posexplode("embedding").alias("place", "x")).select("label", F.col("place").cast("long").alias("place"), F.round("x", 6).alias("x"))


@query("view_storage_census", f"SELECT 't' || user_id % 2 AS tier, event_type AS namespace, count(*) AS files, sum(event_id)::BIGINT AS bytes, epoch_us(min(ts)) AS oldest, epoch_us(max(ts)) AS newest, count(*) FILTER (WHERE epoch_us({_NOW}) - epoch_us(ts) > 864000000000) AS due FROM events GROUP BY 1, 2")
def view_storage_census(t):
    files = t("events").select(F.concat(F.lit("t"), (F.col("user_id") % 2).cast("string")).alias("tier"), F.col("event_type").alias("namespace"), F.col("event_id").alias("size"), F.col("ts").cast("timestamp").alias("modified"))
    return upkeep.storage_census(files, NOW, 10).select("tier", "namespace", "files", "bytes", _us("oldest"), _us("newest"), "due")


@query(
    "view_gauges",
    f"""{WITH} SELECT 'sources' AS name, 's' || k % 3 AS label, count(*)::DOUBLE AS value FROM ev GROUP BY 2 UNION ALL SELECT 'lag_bytes', '', sum(greatest(event_id - k, 0))::DOUBLE FROM ev
    UNION ALL SELECT 'parse_issues', event_type, count(*)::DOUBLE FROM ev GROUP BY 2 UNION ALL SELECT 'unresolved_links', '', count(*)::DOUBLE FROM sessions WHERE parent_uid IS NOT NULL AND parent_uid NOT IN (SELECT session_uid FROM sessions)""",
)
def view_gauges(t):
    """The catalogue's own state as gauges."""
    e = t("events")
    sources = e.select(_s("event_id").alias("path"), F.concat(F.lit("s"), (_k() % 3).cast("string")).alias("status"), F.col("event_id").alias("size"), _k().alias("offset"))
    s = staged(t)["sessions"]
    known = s.select(F.col("session_uid").alias("parent_uid"), F.lit(True).alias("parent_id"))
    return upkeep.gauges(sources, e.select(F.col("event_type").alias("kind")), s.join(known, "parent_uid", "left"))


@query("view_pruned_state", f"{WITH} SELECT session_uid FROM sessions WHERE last_ts >= {_NOW} - INTERVAL 2 DAY OR is_stub")
def view_pruned_state(t):
    return upkeep.pruned(staged(t)["sessions"], "last_ts", NOW, open_flag="is_stub").select("session_uid")


@query("view_reclassified", f"{WITH} SELECT event_uid, message_class, 'human_prompt' AS new_class FROM messages WHERE message_class <> 'human_prompt' AND text LIKE '%5'")
def view_reclassified(t):
    """Messages whose class a new rule changes."""
    return upkeep.reclassified(staged(t)["messages"], F.when(F.col("text").endswith("5"), "human_prompt").otherwise(F.col("message_class")))


_RUNS = f"""{WITH}, launches AS (SELECT byte_offset AS loop_id, session_uid, date_trunc('hour', ts) AS launched_at FROM messages WHERE text LIKE '%7'),
loops AS (SELECT *, lead(launched_at) OVER (PARTITION BY session_uid ORDER BY launched_at, loop_id) AS cutoff FROM launches),
members AS (SELECT loop_id, s.session_uid FROM loops l JOIN sessions s ON s.parent_uid = l.session_uid AND s.first_ts >= launched_at - INTERVAL 90 DAY),
daily AS (SELECT loop_id, model, ts::DATE AS day, sum(input_tokens) AS i, sum(cached_tokens) AS c, sum(cache_write_tokens) AS w, sum(output_tokens) AS o FROM (SELECT loop_id, calls.* FROM loops JOIN calls USING (session_uid) WHERE ts >= launched_at AND (cutoff IS NULL OR ts < cutoff) UNION ALL SELECT loop_id, calls.* FROM members JOIN calls USING (session_uid)) GROUP BY ALL),
usd AS (SELECT loop_id, sum((coalesce(i, 0) * p.input + coalesce(c, 0) * coalesce(p.cached, p.input) + coalesce(w, 0) * coalesce(p.cache_write, p.input) + coalesce(o, 0) * p.output) / 1e6) AS usd FROM daily d LEFT JOIN LATERAL (SELECT * FROM prices p WHERE p.model = d.model AND p.effective_from::DATE <= d.day ORDER BY p.effective_from DESC LIMIT 1) p ON true GROUP BY 1)"""


def _runs(s):
    launches = s["messages"].filter(F.col("text").endswith("7")).select(F.col("byte_offset").alias("loop_id"), "session_uid", F.date_trunc("hour", "ts").alias("launched_at"))
    windows = loops.windows(launches)
    members = windows.select("loop_id", F.col("session_uid").alias("parent_uid")).join(s["sessions"].select("parent_uid", "session_uid"), "parent_uid").select("loop_id", "session_uid")
    return windows, members


def _both(fact: str, what: str, name: str) -> str:
    return f"{name} AS (SELECT loop_id, {what} FROM (SELECT loop_id, f.* FROM loops JOIN {fact} f USING (session_uid) WHERE ts >= launched_at AND (cutoff IS NULL OR ts < cutoff) UNION ALL SELECT loop_id, f.* FROM members JOIN {fact} f USING (session_uid)) GROUP BY 1)"


@query(
    "view_loop_summary",
    f"""{_RUNS}, {_both("calls", "count(*) AS calls, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens", "made")}, {_both("tool_calls", "count(*) AS tool_calls, count(*) FILTER (WHERE is_error) AS tool_errors", "used")}, {_both("messages", "count(*) FILTER (WHERE message_class = 'human_prompt') AS prompts", "said")},
    sizes AS (SELECT loop_id, count(DISTINCT session_uid) AS n FROM members GROUP BY 1)
    SELECT loop_id, (epoch_us(cutoff) - epoch_us(launched_at)) // 1000000 AS wall_seconds, coalesce(calls, 0) AS calls, coalesce(input_tokens, 0) AS input_tokens, coalesce(output_tokens, 0) AS output_tokens, coalesce(tool_calls, 0) AS tool_calls, coalesce(tool_errors, 0) AS tool_errors, coalesce(prompts, 0) AS prompts,
    round(coalesce(usd, 0), 8) AS usd, 1 + coalesce(n, 0) AS sessions FROM loops LEFT JOIN made USING (loop_id) LEFT JOIN used USING (loop_id) LEFT JOIN said USING (loop_id) LEFT JOIN usd USING (loop_id) LEFT JOIN sizes USING (loop_id)""",
)
def view_loop_summary(t):
    """Runs' totals: the root within its window, member sessions whole."""
    s = staged(t)
    windows, members = _runs(s)
    drop = ("agent",)
    return loops.summary(windows, members, s["calls"].drop(*drop), s["tool_calls"], s["messages"], s["prices"]).drop("session_uid", "launched_at", "cutoff").withColumn("usd", F.round("usd", 8))


@query(
    "view_loop_lanes",
    f"""{_RUNS}, c AS (SELECT session_uid, count(*) AS calls FROM calls GROUP BY 1) SELECT loop_id, session_uid, calls, agent || '!' AS completion FROM members JOIN c USING (session_uid) JOIN sessions USING (session_uid)""",
)
def view_loop_lanes(t):
    """A run's member sessions with totals, price and how they ended."""
    s = staged(t)
    rolled = s["calls"].groupBy("session_uid").agg(F.count("*").alias("calls"))
    ends = s["sessions"].select("session_uid", F.concat("agent", F.lit("!")).alias("completion"))
    return loops.lanes(_runs(s)[1], rolled, sessions.session_cost(s["calls"], s["prices"]), ends).select("loop_id", "session_uid", "calls", "completion")


@query(
    "view_loop_membership",
    f"""{_RUNS}, tree AS (SELECT coalesce(parent_uid, session_uid) AS root, session_uid, first_ts FROM sessions), one AS (SELECT loop_id, session_uid, launched_at, 0 AS rank FROM loops UNION ALL
        SELECT l.loop_id, t.session_uid, launched_at, 1 FROM loops l JOIN tree t ON t.root = l.session_uid AND t.session_uid <> t.root AND first_ts >= launched_at AND (cutoff IS NULL OR first_ts < cutoff)),
    a AS (SELECT *, row_number() OVER (PARTITION BY session_uid ORDER BY rank, launched_at DESC, loop_id) AS n FROM one), started AS (SELECT 'u' || (user_id + 1) AS session_uid, session_uid AS by_session FROM (SELECT DISTINCT user_id, session_uid FROM ev) WHERE user_id % 4 = 1),
    two AS (SELECT loop_id, session_uid, launched_at, rank FROM a WHERE n = 1 UNION ALL SELECT a.loop_id, s.session_uid, a.launched_at, 2 FROM a JOIN started s ON s.by_session = a.session_uid WHERE n = 1),
    b AS (SELECT *, row_number() OVER (PARTITION BY session_uid ORDER BY rank, launched_at DESC, loop_id) AS n FROM two) SELECT loop_id, session_uid, ['launch', 'lineage', 'heuristic'][rank + 1] AS method FROM b WHERE n = 1""",
)
def view_loop_membership(t):
    """Which run each session belongs to, and by what evidence."""
    s = staged(t)
    tree = s["sessions"].select(F.coalesce("parent_uid", "session_uid").alias("root"), "session_uid", "first_ts")
    users = t("events").select("user_id").distinct().filter("user_id % 4 = 1")
    started = users.select(F.concat(F.lit("u"), (F.col("user_id") + 1).cast("string")).alias("session_uid"), F.concat(F.lit("u"), _s("user_id")).alias("by_session"))
    return loops.membership(_runs(s)[0], tree, started)


@query(
    "view_lane_briefs",
    """SELECT event_id, CASE WHEN event_id % 4 IN (0, 1) THEN 'AB-' || event_id || CASE WHEN event_id % 4 = 1 THEN '.2' ELSE '' END END AS task_id, CASE WHEN event_id % 4 IN (0, 1) THEN 'fix (' || event_type || ')' END AS title FROM events""",
)
def view_lane_briefs(t):
    """Tasks that briefs name in an exact header line; looser headers name none."""
    n, kind = F.col("event_id"), F.col("event_id") % 4
    head = F.concat(F.lit("Lane: l-1 · Task: AB-"), _s("event_id"), F.when(kind == 1, ".2").otherwise(""), F.lit(" (fix ("), "event_type", F.lit(")) · Tier: "), F.when(kind == 2, "other").when(kind == 3, "routine ").otherwise("routine"))
    text = F.concat(head, F.when(kind == 1, "\r\n").otherwise("\n"), F.lit("Do it."))
    brief = loops.lane_brief_task(text)
    return t("events").select(n, brief["task_id"].alias("task_id"), brief["title"].alias("title"))


@query(
    "view_tasks_done",
    f"""{_RUNS}, l AS (SELECT loop_id, 'r' || loop_id % 7 AS repo, launched_at, cutoff FROM loops), d AS (SELECT 'r' || k % 7 AS repo, 'T-' || k AS task_key, ts AS done_at FROM ev WHERE event_type = 'error')
    SELECT loop_id, CASE WHEN repo IN ('r0', 'r1', 'r2', 'r3') THEN (SELECT count(DISTINCT task_key) FROM d WHERE d.repo = l.repo AND done_at >= launched_at AND (cutoff IS NULL OR done_at < cutoff)) END AS tasks_done FROM l""",
)
def view_tasks_done(t):
    """Tasks done in each run's window; null where the repository was never scanned."""
    windows, _ = _runs(staged(t))
    repo = lambda c: F.concat(F.lit("r"), (c % 7).cast("string"))
    done = t("events").filter("event_type = 'error'").select(repo(_k()).alias("repo"), F.concat(F.lit("T-"), _k().cast("string")).alias("task_key"), F.col("ts").cast("timestamp").alias("done_at"))
    scanned = windows.sparkSession.createDataFrame([(f"r{i}",) for i in range(4)], "repo string")
    return loops.tasks_done(windows.withColumn("repo", repo(F.col("loop_id"))), done, scanned)


@query(
    "view_stalls",
    f"""{WITH}, r AS (SELECT session_uid AS root, last_ts, first_ts, session_uid LIKE '%3' AS paused FROM sessions WHERE last_ts >= {_NOW} - INTERVAL 9 DAY), c AS (SELECT parent_uid AS root, bool_or(session_uid LIKE '%1' AND {_NOW} - last_ts <= INTERVAL 1 HOUR) AS flying, max(last_ts + CASE WHEN session_uid LIKE '%1' THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END) AS until FROM sessions WHERE parent_uid IS NOT NULL GROUP BY 1)
    SELECT root, greatest((epoch_us({_NOW}) - epoch_us(greatest(first_ts, until))) // 1000000, 0) AS seconds FROM r LEFT JOIN c USING (root) WHERE NOT paused AND NOT coalesce(flying, false)""",
)
def view_stalls(t):
    """Live roots without a child in flight, and since when."""
    s = staged(t)["sessions"]
    ends = lambda d: F.col("session_uid").endswith(d)
    none = F.lit(None).cast("timestamp")
    roots = s.select(F.col("session_uid").alias("root"), F.lit(True).alias("in_task"), "last_ts", F.col("first_ts").alias("spawn_ts"), none.alias("human_ts"), ends("3").alias("paused"), none.alias("quiet_until"))
    children = s.filter("parent_uid IS NOT NULL").select(F.col("parent_uid").alias("root"), ends("1").alias("in_task"), "last_ts")
    return loops.stalls(roots, children, NOW, live_minutes=9 * 24 * 60)


_SAMPLES = "SELECT 'x' AS name, 'u' || user_id AS u, regexp_extract(props, '([0-9]+)', 1)::DOUBLE AS v, ts, event_id FROM events"


def _samples(t):
    return t("events").select(F.lit("x").alias("name"), F.create_map(F.lit("u"), F.concat(F.lit("u"), _s("user_id"))).alias("labels"), _k().cast("double").alias("value"), F.col("ts").cast("timestamp").alias("at"))


@query("view_allowed_samples", f"SELECT u, v AS value FROM ({_SAMPLES}) WHERE u IN ('u1', 'u2', 'u3')")
def view_allowed_samples(t):
    """Samples within a vocabulary of names and label values."""
    return metrics.allowed(_samples(t), ["x", "y"], {"u": ["u1", "u2", "u3"], "w": ["z"]}).select(F.element_at("labels", "u").alias("u"), "value")


@query(
    "view_increase_over_window",
    f"""WITH s AS (SELECT u, ts, v, lag(v) OVER (PARTITION BY u ORDER BY ts) AS p FROM ({_SAMPLES}) WHERE ts > {_NOW} - INTERVAL 5 DAY AND ts <= {_NOW})
    SELECT u, sum(CASE WHEN p IS NULL THEN 0 WHEN v < p THEN v ELSE v - p END) AS increase FROM s GROUP BY 1""",
)
def view_increase_over_window(t):
    """Counters' increase over the last five days."""
    return metrics.increase(_samples(t), "at", 5 * 86_400, NOW).select(F.get_json_object("key", "$[0].value").alias("u"), "increase")


@query("view_last_over_window", f"SELECT u, arg_max(v, ts) FILTER (WHERE w) AS last, min(v) FILTER (WHERE w) AS least, count(*) FILTER (WHERE w) = 0 AS absent FROM (SELECT *, ts > {_NOW} - INTERVAL 6 HOUR AND ts <= {_NOW} AS w FROM ({_SAMPLES})) GROUP BY 1")
def view_last_over_window(t):
    """The last and the least value of each series over six hours; series without a sample are absent."""
    return metrics.last_over(_samples(t), "at", 6 * 3600, NOW).select(F.get_json_object("key", "$[0].value").alias("u"), "last", "least", "absent")


@query("view_context_quantiles", f"{WITH} SELECT agent, quantile_disc(input_tokens, 0.5) AS q50, quantile_disc(input_tokens, 0.9) AS q90 FROM calls WHERE ts >= {_NOW} - INTERVAL 3 DAY GROUP BY 1")
def view_context_quantiles(t):
    """Nearest-rank quantiles of the context of calls in the last days, by harness."""
    return metrics.nearest_rank(sessions.scoped(staged(t)["calls"], since="2024-01-22 00:00:00"), ["agent"], "input_tokens", [0.5, 0.9])


@query(
    "view_dedup_commits",
    f"{_GIT} SELECT session_uid, count(DISTINCT CASE WHEN op = 'commit' THEN 'sha:' || left(sha_short, 3) ELSE 'event:' || event_uid END) AS commits FROM git_events GROUP BY 1",
)
def view_dedup_commits(t):
    """Commits counted once by hash, other events each."""
    key = F.when(F.col("op") == "commit", F.concat(F.lit("sha:"), F.left("sha_short", F.lit(3)))).otherwise(F.concat(F.lit("event:"), "event_uid"))
    return _git(t)[1].groupBy("session_uid").agg(F.countDistinct(key).alias("commits"))


@query("view_json_objects", f"""{WITH} SELECT session_uid, '{{' || string_agg('"' || model || '":' || n, ',' ORDER BY model) || '}}' AS models FROM (SELECT session_uid, model, count(*) AS n FROM calls GROUP BY 1, 2) GROUP BY 1""")
def view_json_objects(t):
    """A JSON object of counts by model for each session."""
    n = staged(t)["calls"].groupBy("session_uid", "model").agg(F.count("*").alias("n"))
    return n.groupBy("session_uid").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "n"))))).alias("models"))


@query(
    "view_every_over_session",
    f"{WITH} SELECT call_uid, bool_and(is_error) OVER (PARTITION BY session_uid, tool_name) AS all_failed, epoch_us(min(ts) OVER (PARTITION BY session_uid)) AS first_ts FROM tool_calls",
)
def view_every_over_session(t):
    """Whether a session's calls of a tool all failed, and its first call, on every row."""
    w = Window.partitionBy("session_uid", "tool_name")
    return staged(t)["tool_calls"].select("call_uid", F.bool_and("is_error").over(w).alias("all_failed"), F.unix_micros(F.min("ts").over(Window.partitionBy("session_uid"))).alias("first_ts"))


@query(
    "view_null_orders",
    f"{WITH} SELECT response_id, row_number() OVER (PARTITION BY session_uid ORDER BY output_tokens DESC NULLS FIRST, response_id) AS first_nulls, row_number() OVER (PARTITION BY session_uid ORDER BY CASE model WHEN 'm2' THEN 0 WHEN 'm0' THEN 1 ELSE 5 END, cached_tokens ASC NULLS LAST, response_id) AS last_nulls FROM calls",
)
def view_null_orders(t):
    """Orders with nulls first, with nulls last, and by rank of a value."""
    w = Window.partitionBy("session_uid")
    rank = F.when(F.col("model") == "m2", 0).when(F.col("model") == "m0", 1).otherwise(5)
    n = lambda *order: F.row_number().over(w.orderBy(*order)).cast("long")
    return staged(t)["calls"].select("response_id", n(F.desc_nulls_first("output_tokens"), "response_id").alias("first_nulls"), n(rank, F.asc_nulls_last("cached_tokens"), "response_id").alias("last_nulls"))


@query(
    "view_price_fallbacks",
    f"""{WITH} SELECT response_id, round((input_tokens * p.input + coalesce(cached_tokens, 0) * coalesce(p.cached, p.input) + cache_write_tokens * coalesce(p.cache_write, p.input) + 5 * coalesce(CASE WHEN c.model = 'm2' THEN 0.9 END, p.cache_write, p.input) + coalesce(output_tokens, 0) * p.output) / 1e6, 10) AS usd
    FROM calls c LEFT JOIN LATERAL (SELECT * FROM prices p WHERE p.model = c.model AND p.effective_from::DATE <= c.ts::DATE ORDER BY p.effective_from DESC LIMIT 1) p ON true""",
)
def view_price_fallbacks(t):
    """A call's price: an hour's cache write falls back to five minutes' and then to input."""
    s = staged(t)
    prices = s["prices"].withColumn("cache_write_1h", F.when(F.col("model") == "m2", 0.9))
    calls = s["calls"].withColumns({"day": F.to_date("ts"), "cache_write_1h_tokens": F.lit(5)})
    return sessions.with_price(calls, prices).select("response_id", F.round("usd", 10).alias("usd"))


_COS = "list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7))"


@query(
    "view_vector_ranks",
    f"""WITH b AS (SELECT vec_id // 3 AS doc, min(round(1 - {_COS}, 6)) AS d FROM embeddings WHERE label IN (1, 2, 3, 4) GROUP BY 1), r AS (SELECT doc, row_number() OVER (ORDER BY d, doc) AS rank FROM b QUALIFY rank <= 30)
    SELECT doc, rank, round(1 / (60 + rank), 8) AS score FROM r""",
)
def view_vector_ranks(t):
    """The thirty nearest texts of some classes, each by its best chunk, ranked by vectors alone (a report)."""
    e = t("embeddings")
    asked = vectors.vector_of(e.filter("vec_id = 7"), "embedding")
    best = vectors.best_chunks(e.filter(F.col("label").isin(1, 2, 3, 4)).withColumn("doc", F.floor(F.col("vec_id") / 3)), "doc", "vec_id", "embedding", asked, 30, digits=6)
    return vectors.vector_ranks(best, "doc").select("doc", F.col("rank").cast("long").alias("rank"), F.round("score", 8).alias("score"))


_NEAR = _COS.replace("vec_id = 7", "vec_id = 14")


@query(
    "view_four_list_fusion",
    f"""WITH w AS ({_bm25_sql("any")}), l AS (SELECT doc_id AS id, query_id - 1 AS list, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, CASE query_id WHEN 1 THEN 1.0 ELSE 0.7 END AS w FROM w WHERE query_id <= 2 QUALIFY rank <= 50
    UNION ALL SELECT * FROM (SELECT vec_id, 2, row_number() OVER (ORDER BY round(1 - {_COS}, 6), vec_id) AS rank, 1.0 FROM embeddings) WHERE rank <= 50 UNION ALL SELECT * FROM (SELECT vec_id, 3, row_number() OVER (ORDER BY round(1 - {_NEAR}, 6), vec_id) AS rank, 0.7 FROM embeddings) WHERE rank <= 50)
    SELECT id, round(sum(w / (60 + rank)), 8) AS score, min(rank) FILTER (list = 0) AS rank_0, min(rank) FILTER (list = 1) AS rank_1, min(rank) FILTER (list = 2) AS rank_2, min(rank) FILTER (list = 3) AS rank_3 FROM l GROUP BY 1""",
)
def view_four_list_fusion(t):
    """Four ranked lists of fifty, two of words and two of vectors, fused by rank."""
    docs, e = t("documents"), t("embeddings")
    said = search.bm25(docs, "doc_id", "text", docs.sparkSession.createDataFrame(QUERIES[:2], "query_id int, query string")).select("query_id", F.col("doc_id").alias("id"), F.round("score", 6).alias("s"))
    # each list is cut by a top-k within tasks first, so fifty rows are ranked in one
    rank = lambda df, *order: df.orderBy(*order).limit(50).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).cast("long")).select("id", "rank")
    near = lambda id_: vectors.nearest(e, "vec_id", "embedding", vectors.vector_of(e.filter(F.col("vec_id") == id_), "embedding"), 50, digits=6).withColumnRenamed("vec_id", "id")
    lists = [(rank(said.filter(F.col("query_id") == q), F.desc("s"), F.col("id")), w) for q, w in ((1, 1.0), (2, 0.7))] + [(rank(near(i), F.col("distance"), F.col("id")), w) for i, w in ((7, 1.0), (14, 0.7))]
    return search.fused_lists(lists, ["id"]).withColumn("score", F.round("score", 8))


@query("view_latest_price", f"{WITH} SELECT model, max(effective_from) AS effective_from FROM prices GROUP BY 1")
def view_latest_price(t):
    return latest_per_key(staged(t)["prices"], ["model"], F.desc("effective_from")).select("model", _s("effective_from").alias("effective_from"))


@query("view_roles", f"{WITH} SELECT session_uid, CASE WHEN parent_uid IS NOT NULL THEN 'worker' WHEN session_uid IN (SELECT parent_uid FROM sessions) THEN 'root' ELSE 'solo' END AS role FROM sessions")
def view_roles(t):
    return sessions.roles(staged(t)["sessions"]).select("session_uid", "role")


@query(
    "view_loop_labels",
    f"""{_RUNS} SELECT response_id, coalesce((SELECT loop_id::VARCHAR FROM loops l WHERE l.session_uid = c.session_uid AND l.launched_at <= c.ts AND (cutoff IS NULL OR c.ts < cutoff) ORDER BY launched_at DESC, loop_id DESC LIMIT 1), '(none)') AS loop FROM calls c""",
)
def view_loop_labels(t):
    """Each call's run, by its session's launches."""
    s = staged(t)
    return loops.labelled(s["calls"], _runs(s)[0], "ts", "response_id").select("response_id", "loop")


@query(
    "view_synced",
    """SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'new' ELSE 'old' END AS v FROM events WHERE event_id % 4 <> 0""",
)
def view_synced(t):
    """A mirror after a full pass: newer versions win, what is gone is dropped."""
    e = t("events").select(F.col("event_id").alias("id"))
    stored = e.filter("id % 7 <> 0 OR id % 3 <> 0").select("id", F.lit("old").alias("v"), F.lit(5).alias("version"))
    given = e.filter("id % 4 <> 0").select("id", F.when(F.col("id") % 3 == 0, "new").otherwise("old").alias("v"), F.when(F.col("id") % 3 == 0, 6).otherwise(4).alias("version"))
    return upkeep.synced(stored, given, ["id"], "version", full=True).select("id", "v")


@query("view_repositories", f"{WITH} SELECT cwd AS local_root, regexp_extract(cwd, '[^/]+$') AS name, count(*) AS sessions, epoch_us(min(first_ts)) AS first_ts, epoch_us(max(last_ts)) AS last_ts FROM sessions GROUP BY 1, 2")
def view_repositories(t):
    """Checkouts that sessions worked in."""
    root = names.repo_root(F.col("cwd"))
    return upkeep.repositories(staged(t)["sessions"], root, names.repo_name(root)).select("local_root", "name", "sessions", _us("first_ts"), _us("last_ts"))


@query("view_genuine_and_eligible", f"{WITH} SELECT event_uid, message_class = 'human_prompt' AND text NOT LIKE '%3' AS genuine, length(text || repeat('.', byte_offset % 40)) >= 30 AS eligible FROM messages")
def view_genuine_and_eligible(t):
    """The owner's own words (control commands aren't), and texts long enough to embed."""
    control = F.when(F.col("text").endswith("3"), F.concat(F.lit("<command-name>/Compact</command-name> "), "text")).otherwise(F.col("text"))
    origin = F.when(F.col("text").endswith("3"), "slash_command").otherwise("typed")
    long = F.concat("text", F.repeat(F.lit("."), (F.col("byte_offset") % 40).cast("int")))
    return staged(t)["messages"].select("event_uid", classify.genuine_prompt(F.col("message_class"), origin, control).alias("genuine"), text.eligible(long).alias("eligible"))


@query("view_source_code_terms", r"""WITH p AS (SELECT page_id, 'getHTMLPage' || page_id || '_v' || (page_id % 7) || '/' || url AS s FROM pages)
    SELECT page_id, array_to_string(list_filter(string_split_regex(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '(\p{Ll})(\p{Lu})', '\1 \2', 'g'), '(\p{Lu})(\p{Lu}\p{Ll})', '\1 \2', 'g'), '(\p{L})(\p{N})', '\1 \2', 'g'), '(\p{N})(\p{L})', '\1 \2', 'g')), '[^\p{L}\p{N}]+'), lambda x: x <> ''), ' ') AS terms FROM p""")
def view_source_code_terms(t):
    """Terms of identifiers and paths: camel case, digits and underscores part words."""
    made = F.concat(F.lit("getHTMLPage"), _s("page_id"), F.lit("_v"), (F.col("page_id") % 7).cast("string"), F.lit("/"), "url")
    return t("pages").select("page_id", F.array_join(search.code_tokens(made), " ").alias("terms"))


@query("view_cache_keys", f"{WITH} SELECT event_uid, sha256('[' || message_class || '] ' || CASE WHEN byte_offset % 2 = 0 THEN 'app' ELSE 'ns' END || chr(10) || text) AS key FROM messages")
def view_cache_keys(t):
    """Keys of the vectors of inputs."""
    folder = F.when(F.col("byte_offset") % 2 == 0, F.lit("/x/app"))
    return staged(t)["messages"].select("event_uid", text.cache_key(F.col("message_class"), folder, F.lit("ns"), F.col("text")).alias("key"))


@query("view_canonical_repos", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'new/home' WHEN page_id % 3 = 1 THEN 'own/repo' || page_id ELSE 'just' || page_id END AS repo FROM pages")
def view_canonical_repos(t):
    """Repositories by owner and name, moved ones under their new name."""
    n = F.col("page_id") % 3
    slug = F.when(n == 0, "Host.org/Old/Home").when(n == 1, F.concat(F.lit("host.org/Own/Repo"), _s("page_id"))).otherwise(F.concat(F.lit("Just"), _s("page_id")))
    return t("pages").select("page_id", names.canonical_repo(slug, {"old/home": "new/home"}).alias("repo"))
