"""Report queries: digests with totals, candidates, effects of changes, scored sessions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomlog.operators import search, temporal

from .catalogue import query
from .texts import _TOKENS


@query(
    "continuation_pick",
    """SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 WHEN 'click' THEN 3 ELSE 4 END, ts, event_id) AS n FROM events) WHERE n = 1""",
)
def continuation_pick(t):
    """Of several edges to a session the one of the best kind counts, then the earliest: a minimum of structs."""
    rank = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "click", 3).otherwise(4)
    best = t("events").groupBy("user_id").agg(F.min(F.struct(rank.alias("r"), "ts", "event_id", "event_type")).alias("b"))
    return best.select("user_id", "b.event_id", "b.event_type")


@query(
    "infra_actions_window",
    "SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase' AND ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' - INTERVAL 6 HOUR AND TIMESTAMP '2024-01-10 00:00:00' + INTERVAL 6 HOUR",
)
def infra_actions_window(t):
    """Actions within six hours of a moment; both ends are literals, so the scan skips what lies outside."""
    return t("events").filter((F.col("event_type") == "purchase") & F.col("ts").between(F.lit("2024-01-09 18:00:00").cast("timestamp_ntz"), F.lit("2024-01-10 06:00:00").cast("timestamp_ntz"))).select("event_id", "user_id", "ts")


@query(
    "permission_candidates",
    """SELECT props, count(*) AS denials, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE ok) AS retried_ok FROM (
    SELECT props, user_id, EXISTS (SELECT 1 FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts > e.ts AND epoch_us(p.ts) - epoch_us(e.ts) <= 86400000000) AS ok FROM events e WHERE event_type = 'error') GROUP BY 1 HAVING count(*) >= 2""",
)
def permission_candidates(t):
    """Denials by shape, with how many were retried with success within a day."""
    e = t("events")
    found = temporal.asof_forward(e.filter("event_type = 'error'").select("user_id", "event_id", "ts", "props"), e.filter("event_type = 'purchase'").select("user_id", "event_id", "ts"), ["user_id"], "ts", "ts", "event_id")
    soon = F.unix_micros(F.col("next.ts").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")) <= 86_400_000_000
    return found.groupBy("props").agg(F.count("*").alias("denials"), F.countDistinct("user_id").alias("users"), F.count_if(F.coalesce(soon, F.lit(False))).alias("retried_ok")).filter("denials >= 2")


@query(
    "correction_digest",
    """WITH e AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'error')
    SELECT 'total' AS kind, NULL::BIGINT AS id, count(*) AS n FROM e UNION ALL (SELECT 'session', user_id, count(*) AS n FROM e GROUP BY 2 ORDER BY n DESC, user_id LIMIT 40)
    UNION ALL (SELECT 'followup', event_id, 1 FROM e ORDER BY ts DESC, event_id DESC LIMIT 150)""",
)
def correction_digest(t):
    """A total, the forty sessions with most and the 150 newest (a report): each list is a top-k."""
    e = t("events").filter("event_type = 'error'")
    total = e.agg(F.count("*").alias("n")).select(F.lit("total").alias("kind"), F.lit(None).cast("long").alias("id"), "n")
    top = e.groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(40).select(F.lit("session").alias("kind"), F.col("user_id").alias("id"), "n")
    new = e.orderBy(F.desc("ts"), F.desc("event_id")).limit(150).select(F.lit("followup").alias("kind"), F.col("event_id").alias("id"), F.lit(1).cast("long").alias("n"))
    return total.unionByName(top).unionByName(new)


@query(
    "task_effort",
    """SELECT key, count(*) AS sessions, round(sum(CASE WHEN n = 1 THEN v ELSE 0 END), 2) AS counted, round(sum(v / n), 4) AS shared FROM (
    SELECT o_orderkey, 'K-' || (l_suppkey % 50) AS key, count(*) OVER (PARTITION BY o_orderkey) AS n, any_value(o_totalprice) AS v FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, 2) GROUP BY 1""",
)
def task_effort(t):
    """Effort by task: a session that mentions one task counts for it, one of several is shared among them."""
    keyed = t("lineitem").select("l_orderkey", F.concat(F.lit("K-"), (F.col("l_suppkey") % 50).cast("string")).alias("key")).distinct()
    shared = keyed.withColumn("n", F.count("*").over(Window.partitionBy("l_orderkey")))
    effort = shared.join(t("orders").select("o_orderkey", F.col("o_totalprice").alias("v")), F.col("o_orderkey") == F.col("l_orderkey"))
    return effort.groupBy("key").agg(F.count("*").alias("sessions"), F.round(F.sum(F.when(F.col("n") == 1, F.col("v")).otherwise(0.0)), 2).alias("counted"), F.round(F.sum(F.col("v") / F.col("n")), 4).alias("shared"))


@query(
    "unused_features",
    """WITH k AS (SELECT DISTINCT p_brand AS feature FROM part), u AS (SELECT p_brand AS feature, count(*) AS uses, max(l_shipdate) AS last_use FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_shipdate >= TIMESTAMP '2001-12-01' AND p_size < 3 GROUP BY 1)
    SELECT feature, CASE WHEN uses IS NULL THEN 'unused' WHEN uses < 3 THEN 'rare' ELSE 'used' END AS state, coalesce(uses, 0) AS uses, last_use FROM k LEFT JOIN u USING (feature)""",
)
def unused_features(t):
    """Known features by recent use."""
    known = t("part").select(F.col("p_brand").alias("feature")).distinct()
    recent = t("lineitem").filter(F.col("l_shipdate") >= F.lit("2001-12-01").cast("timestamp_ntz")).select("l_partkey", "l_shipdate")
    used = recent.join(t("part").filter("p_size < 3").select("p_partkey", F.col("p_brand").alias("feature")), F.col("p_partkey") == F.col("l_partkey")).groupBy("feature").agg(F.count("*").alias("uses"), F.max("l_shipdate").alias("last_use"))
    state = F.when(F.col("uses").isNull(), "unused").when(F.col("uses") < 3, "rare").otherwise("used")
    return known.join(used, "feature", "left").select("feature", state.alias("state"), F.coalesce("uses", F.lit(0)).alias("uses"), "last_use")


@query(
    "commit_ci_latest",
    """SELECT o_custkey, o_orderpriority, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1""",
)
def commit_ci_latest(t):
    """The latest run of each workflow of a commit."""
    newest = t("orders").groupBy("o_custkey", "o_orderpriority").agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")).alias("r"))
    return newest.select("o_custkey", "o_orderpriority", "r.o_orderkey", "r.o_orderstatus")


@query(
    "rule_effect_rates",
    """WITH c AS (SELECT o_custkey, min(o_orderdate) AS t0 FROM orders WHERE o_totalprice > 400000 GROUP BY 1)
    SELECT c.o_custkey, round(count(*) FILTER (WHERE o.o_orderdate < t0 AND o.o_orderstatus = 'F') * 100.0 / nullif(count(*) FILTER (WHERE o.o_orderdate < t0), 0), 4) AS before_rate,
    round(count(*) FILTER (WHERE o.o_orderdate >= t0 AND o.o_orderstatus = 'F') * 100.0 / nullif(count(*) FILTER (WHERE o.o_orderdate >= t0), 0), 4) AS after_rate FROM c JOIN orders o USING (o_custkey) GROUP BY 1""",
)
def rule_effect_rates(t):
    """Rates before and after the first change of each owner: the change comes from a window, so the orders are read and dealt once."""
    o = t("orders").select("o_custkey", "o_orderdate", "o_orderstatus", "o_totalprice")
    at = F.min(F.when(F.col("o_totalprice") > 400000, F.col("o_orderdate"))).over(Window.partitionBy("o_custkey"))
    done, early = F.col("o_orderstatus") == "F", F.col("o_orderdate") < F.col("at")
    rate = lambda part: F.round(F.count_if(part & done) * 100.0 / F.nullif(F.count_if(part), F.lit(0)), 4)
    return o.withColumn("at", at).filter("at IS NOT NULL").groupBy("o_custkey").agg(rate(early).alias("before_rate"), rate(~early).alias("after_rate"))


@query(
    "find_sessions_score",
    rf"""WITH d AS (SELECT doc_id, source, {_TOKENS} AS ts FROM documents), s AS (SELECT count(*)::DOUBLE AS n, avg(len(ts)) AS m FROM d WHERE len(ts) > 0),
    p AS (SELECT doc_id, source, any_value(len(ts)) AS n, count(*) FILTER (WHERE term = 'heed') AS tf FROM (SELECT doc_id, source, ts, unnest(ts) AS term FROM d) GROUP BY 1, 2 HAVING count(*) FILTER (WHERE term = 'heed') > 0),
    f AS (SELECT count(*) AS df FROM p), h AS (SELECT source, ln(1 + (s.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * p.n / m)) AS score FROM p, s, f)
    SELECT source, count(*) AS hits, round(max(score) + ln(1 + count(*)), 6) AS score FROM h GROUP BY 1""",
)
def find_sessions_score(t):
    """Sources by their best hit, raised by the logarithm of the number of hits."""
    docs = t("documents")
    queries = docs.sparkSession.createDataFrame([(1, "heed")], "query_id int, query string")
    hits = search.bm25(docs, "doc_id", "text", queries).join(docs.select("doc_id", "source"), "doc_id")
    return hits.groupBy("source").agg(F.count("*").alias("hits"), F.round(F.max("score") + F.log(1 + F.count("*")), 6).alias("score"))


@query(
    "search_fields",
    rf"""SELECT page_id, (CASE WHEN list_contains(u, 'blog') THEN 2 ELSE 0 END + CASE WHEN list_contains(h, 'track') THEN 1 ELSE 0 END) AS score FROM (SELECT page_id, {_TOKENS.replace("text", "url")} AS u, {_TOKENS.replace("text", "html")} AS h FROM pages)
    WHERE list_contains(u, 'blog') OR list_contains(h, 'track')""",
)
def search_fields(t):
    """A term search over two fields with weights, in one pass over the pages."""
    has = lambda c, w: F.array_contains(search.plain_tokens(F.col(c)), w)
    score = has("url", "blog").cast("int") * 2 + has("html", "track").cast("int")
    return t("pages").select("page_id", score.alias("score")).filter("score > 0")


@query("progress_diagnostics", "SELECT 'orders' AS stream, count(*) AS n, count(o_totalprice) AS known, max(o_orderdate) AS newest FROM orders UNION ALL SELECT 'lineitem', count(*), count(l_quantity), max(l_shipdate) FROM lineitem UNION ALL SELECT 'events', count(*), count(value), max(ts) FROM events")
def progress_diagnostics(t):
    """Volume, known values and newest row of three streams."""
    one = lambda table, value, at: t(table).agg(F.count("*").alias("n"), F.count(value).alias("known"), F.max(at).alias("newest")).select(F.lit(table).alias("stream"), "n", "known", "newest")
    return one("orders", "o_totalprice", "o_orderdate").unionByName(one("lineitem", "l_quantity", "l_shipdate")).unionByName(one("events", "value", "ts"))
