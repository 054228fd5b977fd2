"""Queries over the event stream, which stands for calls and session events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomlog.operators import temporal
from loomlog.operators.merge import MergeSpec, changes, known_sum

from .catalogue import query

_MICROS = "(epoch_us({}) - epoch_us({}))"


@query("nearest_rank_quantile", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90 FROM events GROUP BY 1")
def nearest_rank_quantile(t):
    """Quantiles that are values of the data: the ceil(q n)-th smallest."""
    q = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY value)")
    return t("events").groupBy("event_type").agg(q(0.5).alias("p50"), q(0.9).alias("p90"))


@query(
    "week_with_total_row",
    """SELECT coalesce(day, '(all)') AS day, n, users, kinds FROM (
    SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT user_id) AS users, string_agg(DISTINCT event_type, ' | ' ORDER BY event_type) AS kinds
    FROM events WHERE ts < TIMESTAMP '2024-01-08' GROUP BY GROUPING SETS ((day), ()))""",
)
def week_with_total_row(t):
    """A week by day with a total, from one pass with grouping sets."""
    week = t("events").filter(F.col("ts") < F.lit("2024-01-08").cast("timestamp_ntz")).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    kinds = F.array_join(F.array_sort(F.collect_set("event_type")), " | ")
    return week.rollup("day").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), kinds.alias("kinds")).withColumn("day", F.coalesce("day", F.lit("(all)")))


@query(
    "feature_usage_union",
    """SELECT day, feature, n FROM (SELECT date_trunc('day', ts)::TIMESTAMP AS day, 'event:' || event_type AS feature, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2
    UNION ALL SELECT date_trunc('day', ts)::TIMESTAMP, 'high value', count(*) FROM events WHERE value > 100 GROUP BY 1)""",
)
def feature_usage_union(t):
    """Uses of features by day, from event kinds and from a property."""
    day = F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")
    kinds = t("events").filter(F.col("event_type").isin("click", "view")).select(day, F.concat(F.lit("event:"), "event_type").alias("feature"))
    high = t("events").filter("value > 100").select(day, F.lit("high value").alias("feature"))
    return kinds.unionByName(high).groupBy("day", "feature").agg(F.count("*").alias("n"))


@query(
    "notify_lag_asof_forward",
    """SELECT v.event_id, p.event_id AS next_id, epoch_us(p.ts) - epoch_us(v.ts) AS lag_us FROM (SELECT * FROM events WHERE event_type = 'view') v
    LEFT JOIN LATERAL (SELECT event_id, ts FROM events p WHERE p.event_type = 'purchase' AND p.user_id = v.user_id AND p.ts > v.ts ORDER BY ts, event_id LIMIT 1) p ON true""",
)
def notify_lag_asof_forward(t):
    """From each notification to the next call of the same user."""
    e = t("events")
    right = e.filter("event_type = 'purchase'").select("user_id", "event_id", "ts")
    found = temporal.asof_forward(e.filter("event_type = 'view'").select("user_id", "event_id", "ts"), right, ["user_id"], "ts", "ts", "event_id")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return found.select("event_id", F.col("next.event_id").alias("next_id"), (micros("next.ts") - micros("ts")).alias("lag_us"))


@query(
    "last_before_asof",
    """SELECT e.event_id, p.event_id AS last_id, p.value AS last_value FROM (SELECT * FROM events WHERE event_type = 'error') e
    LEFT JOIN LATERAL (SELECT event_id, value FROM events p WHERE p.event_type = 'click' AND p.user_id = e.user_id AND p.ts <= e.ts ORDER BY ts DESC, event_id DESC LIMIT 1) p ON true""",
)
def last_before_asof(t):
    """The last prompt at or before each error."""
    e = t("events")
    right = e.filter("event_type = 'click'").select("user_id", "event_id", "ts", "value")
    found = temporal.asof_backward(e.filter("event_type = 'error'").select("user_id", "event_id", "ts"), right, ["user_id"], "ts", "ts", "event_id")
    return found.select("event_id", F.col("last.event_id").alias("last_id"), F.col("last.value").alias("last_value"))


@query(
    "error_then_prompt_2h",
    """SELECT e.event_id, c.event_id AS prompt_id FROM (SELECT * FROM events WHERE event_type = 'error') e
    JOIN LATERAL (SELECT event_id, ts FROM events c WHERE c.event_type = 'click' AND c.user_id = e.user_id AND c.ts > e.ts ORDER BY ts, event_id LIMIT 1) c ON true
    WHERE epoch_us(c.ts) - epoch_us(e.ts) <= 7200000000""",
)
def error_then_prompt_2h(t):
    """Errors that the next prompt follows within two hours."""
    e = t("events")
    right = e.filter("event_type = 'click'").select("user_id", "event_id", "ts")
    found = temporal.asof_forward(e.filter("event_type = 'error'").select("user_id", "event_id", "ts"), right, ["user_id"], "ts", "ts", "event_id")
    soon = F.unix_micros(F.col("next.ts").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")) <= 7_200_000_000
    return found.filter(soon).select("event_id", F.col("next.event_id").alias("prompt_id"))


@query(
    "retried_ok_within_window",
    """SELECT event_id, EXISTS (SELECT 1 FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts > e.ts AND epoch_us(p.ts) - epoch_us(e.ts) <= 21600000000) AS retried_ok
    FROM events e WHERE event_type = 'error'""",
)
def retried_ok_within_window(t):
    """Whether something succeeded within six hours of an error: the next success tells."""
    e = t("events")
    right = e.filter("event_type = 'purchase'").select("user_id", "event_id", "ts")
    found = temporal.asof_forward(e.filter("event_type = 'error'").select("user_id", "event_id", "ts"), right, ["user_id"], "ts", "ts", "event_id")
    soon = F.unix_micros(F.col("next.ts").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")) <= 21_600_000_000
    return found.select("event_id", F.coalesce(soon, F.lit(False)).alias("retried_ok"))


@query(
    "latest_per_key",
    "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
)
def latest_per_key(t):
    """The newest event of each user, aggregated before the shuffle."""
    newest = t("events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type", "value")).alias("e"))
    return newest.select("user_id", "e.event_id", "e.event_type", "e.value")


@query(
    "trigger_attribution_lag",
    """SELECT coalesce(prev, 'none') AS trigger, event_type, count(*) AS n FROM (
    SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) GROUP BY 1, 2""",
)
def trigger_attribution_lag(t):
    """What came right before each event of a user."""
    prev = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t("events").select("event_type", F.coalesce(prev, F.lit("none")).alias("trigger")).groupBy("trigger", "event_type").agg(F.count("*").alias("n"))


@query(
    "active_seconds_gap",
    """SELECT user_id, coalesce(sum(g) FILTER (WHERE g <= 7200), 0)::BIGINT AS active_seconds FROM (
    SELECT user_id, floor((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1000000)::BIGINT AS g FROM events) GROUP BY 1""",
)
def active_seconds_gap(t):
    """Time between a user's events, long pauses left out."""
    return temporal.active_seconds(t("events"), ["user_id"], "ts", "event_id", 7200)


@query(
    "lane_sessions_30min",
    """SELECT user_id, s AS session_no, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM (
    SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) ::BIGINT AS s FROM (
    SELECT *, CASE WHEN floor((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1000000) <= 1800 THEN 0 ELSE 1 END AS new FROM events)) GROUP BY 1, 2""",
)
def lane_sessions_30min(t):
    """Sessions that half an hour without events ends."""
    return temporal.gap_sessions(t("events"), ["user_id"], "ts", "event_id", 1800).groupBy("user_id", "session_no").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(
    "time_state_attribution",
    """SELECT state, sum(s)::BIGINT AS seconds FROM (SELECT CASE WHEN s > 86400 THEN 'gap' WHEN prev = 'click' THEN 'model' WHEN prev IN ('view', 'purchase') THEN 'tool_' || prev ELSE 'idle' END AS state, s FROM (
    SELECT lag(event_type) OVER w AS prev, floor((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1000000)::BIGINT AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE s IS NOT NULL) GROUP BY 1""",
)
def time_state_attribution(t):
    """Each pause is charged to the state that the last event left: model, a tool, idle, or a gap if it is too long."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = t("events").select(F.lag("event_type").over(w).alias("prev"), temporal.seconds_between(F.col("ts"), F.lag("ts").over(w)).alias("s")).filter("s IS NOT NULL")
    state = F.when(F.col("s") > 86400, "gap").when(F.col("prev") == "click", "model").when(F.col("prev").isin("view", "purchase"), F.concat(F.lit("tool_"), "prev")).otherwise("idle")
    return steps.groupBy(state.alias("state")).agg(F.sum("s").alias("seconds"))


@query(
    "rate_limit_forecast",
    """WITH s AS (SELECT user_id, ts, event_id, value, row_number() OVER w AS n, first_value(ts) OVER w AS last_ts, first_value(value) OVER w AS last_value FROM events WHERE event_type = 'view' WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)),
    r AS (SELECT user_id, max(last_value) AS used, max(epoch_us(last_ts)) - min(epoch_us(ts)) AS us, arg_min(value, (ts, event_id)) AS first_value FROM s WHERE epoch_us(last_ts) - epoch_us(ts) <= 432000000000 GROUP BY 1)
    SELECT user_id, used, round(CASE WHEN us > 0 THEN (used - first_value) / (us / 3600000000.0) END, 6) AS burn_per_hour,
    round(CASE WHEN us > 0 AND used > first_value THEN (100 - used) / ((used - first_value) / (us / 3600000000.0)) END, 4) AS hours_left FROM r""",
)
def rate_limit_forecast(t):
    """The latest sample of each window, its burn an hour over the last five days, and the hours until 100."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    s = t("events").filter("event_type = 'view'").select("user_id", "event_id", "value", micros.alias("us")).withColumn("ts", F.col("us"))
    s = s.withColumn("last_us", F.first("us").over(w)).withColumn("used", F.first("value").over(w)).filter("last_us - us <= 432000000000")
    r = s.groupBy("user_id").agg(F.max("used").alias("used"), (F.max("last_us") - F.min("us")).alias("span"), F.min_by("value", F.struct("us", "event_id")).alias("begin"))
    burn = (F.col("used") - F.col("begin")) / (F.col("span") / 3_600_000_000.0)
    return r.select("user_id", "used", F.round(F.when(F.col("span") > 0, burn), 6).alias("burn_per_hour"), F.round(F.when((F.col("span") > 0) & (F.col("used") > F.col("begin")), (100 - F.col("used")) / burn), 4).alias("hours_left"))


@query("hourly_tumbling", "SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def hourly_tumbling(t):
    """Counts and sums by hour."""
    return t("events").groupBy(F.window("ts", "1 hour")["start"].alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(
    "sliding_10min",
    """SELECT begin, count(*) AS n FROM (SELECT unnest(range(0, 2)) AS k, time_bucket(INTERVAL 5 minutes, ts, TIMESTAMP '1970-01-01') AS b FROM events) x, LATERAL (SELECT b - k * INTERVAL 5 minutes AS begin) GROUP BY 1""",
)
def sliding_10min(t):
    """Events of the ten minutes from every fifth minute on."""
    return t("events").groupBy(F.window("ts", "10 minutes", "5 minutes")["start"].alias("begin")).agg(F.count("*").alias("n"))


@query(
    "counter_reset_adjust",
    """SELECT user_id, round(sum(CASE WHEN prev IS NULL OR v < prev THEN v ELSE v - prev END), 6) AS increase FROM (
    SELECT user_id, value AS v, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) GROUP BY 1""",
)
def counter_reset_adjust(t):
    """The increase of a counter that starts again when it falls."""
    run = temporal.reset_adjusted(t("events"), ["user_id"], "value", F.col("ts"), F.col("event_id"))
    return run.groupBy("user_id").agg(F.round(F.max_by("adjusted", F.struct("ts", "event_id")), 6).alias("increase"))


@query(
    "histogram_buckets",
    "SELECT event_type, le, count(*) FILTER (WHERE value <= le) AS n FROM events, (SELECT unnest([5.0, 10.0, 25.0, 50.0, 100.0, 'inf'::DOUBLE]::DOUBLE[]) AS le) GROUP BY 1, 2",
)
def histogram_buckets(t):
    """Cumulative bucket counts: one pass, then the six counts are unfolded."""
    edges = [5.0, 10.0, 25.0, 50.0, 100.0, float("inf")]
    counted = t("events").groupBy("event_type").agg(*[F.count_if(F.col("value") <= e).alias(f"b{i}") for i, e in enumerate(edges)])
    pairs = F.array(*[F.struct(F.lit(e).alias("le"), F.col(f"b{i}").alias("n")) for i, e in enumerate(edges)])
    return counted.select("event_type", F.inline(pairs))


@query(
    "first_n_label_cap",
    """SELECT coalesce(k.label, 'other') AS label, count(*) AS n FROM (SELECT json_extract_string(props, '$.k') AS l FROM events) e
    LEFT JOIN (SELECT label FROM (SELECT json_extract_string(props, '$.k') AS label, min((ts, event_id)) AS f FROM events GROUP BY 1) ORDER BY f LIMIT 20) k ON k.label = e.l GROUP BY 1""",
)
def first_n_label_cap(t):
    """The first twenty labels seen keep their name, later ones are 'other'. The twenty are found by a top-k, then broadcast."""
    e = t("events").select("event_id", "ts", F.get_json_object("props", "$.k").alias("l"))
    known = e.groupBy("l").agg(F.min(F.struct("ts", "event_id")).alias("f")).orderBy("f").limit(20).select(F.col("l").alias("label"))
    return e.join(F.broadcast(known), F.col("l") == F.col("label"), "left").groupBy(F.coalesce("label", F.lit("other")).alias("label")).agg(F.count("*").alias("n"))


@query(
    "json_props_aggregate",
    "SELECT event_type, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS k_sum, max(json_extract(props, '$.k')::BIGINT) AS k_max, count(DISTINCT json_extract(props, '$.k')) AS k_distinct FROM events GROUP BY 1",
)
def json_props_aggregate(t):
    k = F.get_json_object("props", "$.k").cast("long")
    return t("events").groupBy("event_type").agg(F.sum(k).alias("k_sum"), F.max(k).alias("k_max"), F.countDistinct(k).alias("k_distinct"))


@query(
    "hook_latency_multi_distinct",
    """SELECT event_type, count(*) AS runs, count(DISTINCT user_id) AS users, count(DISTINCT props) AS shapes, count(DISTINCT date_trunc('day', ts)) AS days,
    round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS worst FROM events GROUP BY 1""",
)
def hook_latency_multi_distinct(t):
    return t("events").groupBy("event_type").agg(
        F.count("*").alias("runs"), F.countDistinct("user_id").alias("users"), F.countDistinct("props").alias("shapes"), F.countDistinct(F.date_trunc("day", "ts")).alias("days"),
        F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.95), 6).alias("p95"), F.max("value").alias("worst"),
    )


@query(
    "merge_policies",
    """SELECT user_id, arg_min(event_type, event_id) AS first_type, arg_max(value, event_id) AS last_value, max(value) AS top, min(ts) AS since, bool_or(event_type = 'error') AS any_error, max(event_id) AS event_id FROM events GROUP BY 1""",
)
def merge_policies(t):
    """Two batches of observations merged by the policies KEEP, UPDATE, MAX, MIN and OR."""
    e = t("events").select("user_id", "event_id", F.col("event_type").alias("first_type"), F.col("value").alias("last_value"), F.col("value").alias("top"), F.col("ts").alias("since"), (F.col("event_type") == "error").alias("any_error"))
    spec = MergeSpec(("user_id",), {"first_type": "KEEP", "last_value": "UPDATE", "top": "MAX", "since": "MIN", "any_error": "OR"}, "event_id")
    half = F.col("event_id") < 500
    return spec.merge(e.filter(half), e.filter(~half)).select("user_id", "first_type", "last_value", "top", "since", "any_error", "event_id")


@query(
    "full_outer_change_counts",
    """SELECT count(*) FILTER (WHERE o.k IS NULL) AS inserted, count(*) FILTER (WHERE o.k IS NOT NULL AND n.k IS NOT NULL AND (o.v IS DISTINCT FROM n.v)) AS updated,
    count(*) FILTER (WHERE o.k IS NOT NULL AND n.k IS NOT NULL AND (o.v IS NOT DISTINCT FROM n.v)) AS unchanged, count(*) FILTER (WHERE n.k IS NULL) AS missing
    FROM (SELECT event_id AS k, event_type AS v FROM events WHERE event_id % 3 <> 0) o FULL JOIN
    (SELECT event_id AS k, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS v FROM events WHERE event_id % 5 <> 0) n ON o.k = n.k""",
)
def full_outer_change_counts(t):
    """What an upsert of one version of a table over another would insert and update."""
    e = t("events")
    old = e.filter("event_id % 3 <> 0").select("event_id", "event_type")
    new = e.filter("event_id % 5 <> 0").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("event_type"))
    return changes(old, new, ["event_id"], ["event_type"])


@query(
    "known_or_null_sum",
    "SELECT user_id, round(CASE WHEN count(v) = count(*) THEN sum(v) END, 4) AS total FROM (SELECT user_id, CASE WHEN value < 95 THEN value END AS v FROM events) GROUP BY 1",
)
def known_or_null_sum(t):
    """A total only where every part is known."""
    e = t("events").select("user_id", F.when(F.col("value") < 95, F.col("value")).alias("v"))
    return e.groupBy("user_id").agg(F.round(known_sum(F.col("v")), 4).alias("total"))


@query(
    "wrapped_report",
    """SELECT count(*) AS events, count(DISTINCT user_id) AS users, arg_max(h, (n_h, -h)) AS busiest_hour, (SELECT arg_max(d, (n, d)) FROM (SELECT dayname(ts) AS d, count(*) AS n FROM events GROUP BY 1)) AS busiest_weekday
    FROM (SELECT user_id, hour(ts) AS h, count(*) OVER (PARTITION BY hour(ts)) AS n_h FROM events)""",
)
def wrapped_report(t):
    """A year in one row: busiest hour (ties to the earlier) and weekday (ties to the later name). Hours are counted first."""
    e = t("events")
    hour = e.groupBy(F.hour("ts").alias("h")).agg(F.count("*").alias("n")).agg(F.max_by("h", F.struct("n", -F.col("h"))).alias("busiest_hour"))
    weekday = e.groupBy(F.date_format("ts", "EEEE").alias("d")).agg(F.count("*").alias("n")).agg(F.max_by("d", F.struct("n", "d")).alias("busiest_weekday"))
    total = e.agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"))
    one = lambda df: df.withColumn("one", F.lit(1))
    return one(total).join(one(hour), "one").join(one(weekday), "one").select("events", "users", F.col("busiest_hour").cast("long").alias("busiest_hour"), "busiest_weekday")


@query(
    "correction_signals",
    """SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'error' AND value > 50) AS costly_errors,
    round(count(*) FILTER (WHERE event_type = 'error') * 1000.0 / nullif(count(*) FILTER (WHERE event_type = 'click'), 0), 4) AS per_1k FROM events GROUP BY 1""",
)
def correction_signals(t):
    error = F.col("event_type") == "error"
    clicks = F.count_if(F.col("event_type") == "click")
    return t("events").groupBy("user_id").agg(F.count_if(error).alias("errors"), F.count_if(error & (F.col("value") > 50)).alias("costly_errors"), F.round(F.count_if(error) * 1000.0 / F.nullif(clicks, F.lit(0)), 4).alias("per_1k"))


@query(
    "error_share_hourly",
    """SELECT c.hour, c.calls, coalesce(e.errors, 0) AS errors, round(coalesce(e.errors, 0) * 1000.0 / c.calls, 4) AS per_1k FROM (SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, count(*) AS calls FROM events GROUP BY 1) c
    LEFT JOIN (SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY 1) e USING (hour)""",
)
def error_share_hourly(t):
    """One class of error against all calls of the hour: conditional counts, no join."""
    errors = F.count_if(F.col("event_type") == "error")
    return t("events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("calls"), errors.alias("errors"), F.round(errors * 1000.0 / F.count("*"), 4).alias("per_1k"))


@query(
    "active_sessions",
    """WITH n AS (SELECT max(ts) AS now FROM events) SELECT user_id, max(ts) AS last_ts, arg_max(event_type, (ts, event_id)) AS last_type, count(*) AS n FROM events, n
    WHERE epoch_us(now) - epoch_us(ts) <= 86400000000 GROUP BY user_id""",
)
def active_sessions(t):
    """Who was active in the last day of the data, with the last event of each."""
    e = t("events")
    now = e.agg(F.max("ts").alias("now")).first()["now"]
    return e.filter(F.col("ts") >= F.expr(f"timestamp_ntz'{now}' - INTERVAL 1 DAY")).groupBy("user_id").agg(F.max("ts").alias("last_ts"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.count("*").alias("n"))


@query(
    "session_events_page",
    """SELECT user_id, seq, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events) WHERE seq > 10 AND seq <= 30""",
)
def session_events_page(t):
    """A page of twenty events of every session, after the tenth."""
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t("events").withColumn("seq", seq.cast("long")).filter("seq > 10 AND seq <= 30").select("user_id", "seq", "event_id", "event_type")


@query(
    "session_state",
    """WITH n AS (SELECT max(ts) AS now FROM events), l AS (SELECT user_id, max(ts) AS last_ts, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY 1)
    SELECT user_id, last_ts, (CASE WHEN last_type = 'click' THEN epoch_us(now) - epoch_us(last_ts) < 21600000000 ELSE epoch_us(now) - epoch_us(last_ts) < 1800000000 END) AS is_open FROM l, n""",
)
def session_state(t):
    """Open or settled: half an hour after the last event, six hours if that left a turn open."""
    e = t("events")
    now = F.lit(e.agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("now")).first()["now"])
    last = e.groupBy("user_id").agg(F.max("ts").alias("last_ts"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"))
    age = now - F.unix_micros(F.col("last_ts").cast("timestamp"))
    return last.select("user_id", "last_ts", (age < F.when(F.col("last_type") == "click", 21_600_000_000).otherwise(1_800_000_000)).alias("is_open"))
