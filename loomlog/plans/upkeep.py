"""What keeps the catalogue whole: usage filled in, prices seeded, tiers reconciled, embeddings kept up, stored state censused."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.operators import vectors

USAGE = ("input_tokens", "cached_tokens", "cache_write_tokens", "output_tokens")
#: Failures of an input after which it isn't tried again.
MOST_FAILURES = 3
#: Least characters, or bytes that always hold as many, of a text that is embedded.
LEAST_CHARS, LEAST_BYTES = 30, 120
DAY = 86_400_000_000


def visible(sessions: DataFrame, rebuilding: bool = False) -> DataFrame:
    """Sessions that were seen themselves (stubs are only referred to); none while the catalogue is rebuilt."""
    return sessions.filter(F.lit(not rebuilding) & ~F.coalesce("is_stub", F.lit(False)))


def conversation_calls(calls: DataFrame) -> DataFrame:
    """Calls of the conversation itself: not usage records, compactions or branch summaries, and with any usage known."""
    stop = F.col("stop_reason")
    spoken = stop.isNull() | ~(stop.startswith("usage:") | stop.isin("compaction", "branch_summary"))
    return calls.filter(spoken & (F.coalesce(*USAGE).isNotNull()))


def unknown_usage(stop_reason: str = "stop_reason") -> Column:
    """Whether a call's usage wasn't told: nothing but zeros and nulls, and no reason why it stopped."""
    none = F.col(stop_reason).isNull()
    for c in USAGE:
        none = none & (F.coalesce(c, F.lit(0)) == 0)
    return none


def filled_usage(calls: DataFrame, spend: DataFrame) -> DataFrame:
    """calls with the usage of a spend log (request_id, prompt_tokens, cached, written, completion_tokens) where theirs is unknown.
    Prompt tokens include what was cached and written. What is known stays as it is, also where the log differs."""
    latest = spend.groupBy("request_id").agg(F.max(F.struct("prompt_tokens", "cached", "written", "completion_tokens")).alias("s"))
    met = calls.join(latest, F.col("response_id") == F.col("request_id"), "left")
    s = lambda c: F.coalesce(F.col(f"s.{c}"), F.lit(0))
    new = {"input_tokens": F.greatest(s("prompt_tokens") - s("cached") - s("written"), F.lit(0)), "cached_tokens": s("cached"), "cache_write_tokens": s("written"), "output_tokens": s("completion_tokens")}
    fill = unknown_usage() & F.col("s").isNotNull()
    return met.select(*[(F.when(fill, new[c]).otherwise(F.col(c)) if c in new else F.col(c)).alias(c) for c in calls.columns], fill.alias("filled"))


def seeded(prices: DataFrame, seed: DataFrame, key: Sequence[str] = ("model", "effective_from")) -> DataFrame:
    """prices and the seed's rows of keys that prices doesn't have: an owner's row is never replaced."""
    return prices.unionByName(seed.join(prices, list(key), "left_anti").select(*prices.columns))


def reconciled(stored: DataFrame, observed: DataFrame, key: Sequence[str], flag: str) -> DataFrame:
    """What a full observation does to stored rows: key, and the action: demote (stored and flagged, but not seen), restore (seen
    but not flagged), insert (seen, not stored), keep. The rows of an action other than keep are the audit."""
    s = stored.select(*key, F.col(flag).alias("_flag"), F.lit(True).alias("_stored"))
    o = observed.select(*key).distinct().withColumn("_seen", F.lit(True))
    seen, known, flagged = F.col("_seen").isNotNull(), F.col("_stored").isNotNull(), F.coalesce("_flag", F.lit(False))
    action = F.when(seen & ~known, "insert").when(seen & ~flagged, "restore").when(~seen & flagged, "demote").otherwise("keep")
    return s.join(o, list(key), "full").select(*key, action.alias("action"))


def availability(catalogued: DataFrame, hot: DataFrame, cold: DataFrame) -> DataFrame:
    """Where each catalogued source (path) can still be read: hot, cold or missing; and sources that no one has catalogued: new."""
    tier = lambda df, name: df.select("path", F.lit(True).alias(name)).distinct()
    both = catalogued.select("path", F.lit(True).alias("_known")).join(tier(hot, "_hot"), "path", "full").join(tier(cold, "_cold"), "path", "full")
    where = F.when(F.col("_known").isNull(), "new").when(F.col("_hot"), "hot").when(F.col("_cold"), "cold").otherwise("missing")
    return both.select("path", where.alias("availability"))


def embedding_work(messages: DataFrame, chunks: DataFrame, failures: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Messages (event_uid, content_sha, message_class, text) to be embedded: of the classes, long enough, without a chunk of their
    present content (event_uid, source_sha), and failed less than MOST_FAILURES times (event_uid, content_sha, failures)."""
    long = (F.octet_length("text") >= LEAST_BYTES) | (F.length("text") >= LEAST_CHARS)
    asked = messages.filter(F.col("message_class").isin(*classes) & long)
    done = chunks.select("event_uid", F.col("source_sha").alias("content_sha"))
    given_up = failures.filter(F.col("failures") >= MOST_FAILURES).select("event_uid", "content_sha")
    return asked.join(done, ["event_uid", "content_sha"], "left_anti").join(given_up, ["event_uid", "content_sha"], "left_anti")


def cached(work: DataFrame, stored: DataFrame, input_sha: str = "input_sha") -> DataFrame:
    """work with known: whether a vector of its input is stored already, so that it is not paid for again."""
    have = stored.select(F.col("input_sha").alias(input_sha), F.lit(True).alias("_have")).distinct()
    return work.join(have, input_sha, "left").withColumn("known", F.coalesce("_have", F.lit(False))).drop("_have")


def garbage(stored: DataFrame, chunks: DataFrame, now, days: int, chunks_reset=None, backlog: bool = False, quiet_days: int = 7) -> DataFrame:
    """Stored vectors (model, input_sha, created_at) that no chunk refers to and that are older than so many days; none while work
    is pending or soon after all chunks were dropped, when references are about to come back."""
    at = F.unix_micros(F.lit(now).cast("timestamp"))
    settled = F.lit(not backlog) & (F.lit(chunks_reset).isNotNull() if chunks_reset is None else at - F.unix_micros(F.lit(chunks_reset).cast("timestamp")) >= quiet_days * DAY)
    old = stored.filter(settled & (F.unix_micros("created_at") < at - days * DAY))
    return old.join(chunks, ["model", "input_sha"], "left_anti")


def session_vectors(chunk_vectors: DataFrame, session: str, vector: str, changed: DataFrame | None = None) -> DataFrame:
    """The mean of each session's chunk vectors at unit length; with changed (session) only of those."""
    own = chunk_vectors if changed is None else chunk_vectors.join(changed.select(session).distinct(), session, "left_semi")
    return vectors.mean_vector(own, session, vector).withColumn(vector, vectors.normalised(F.col(vector)))


def storage_census(files: DataFrame, now, retention_days: int) -> DataFrame:
    """Files, bytes and ages by tier and namespace (tier, namespace, size, modified), and how many are past their retention."""
    age = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("modified")
    return files.groupBy("tier", "namespace").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.min("modified").alias("oldest"), F.max("modified").alias("newest"), F.count_if(age > retention_days * DAY).alias("due"))


def gauges(sources: DataFrame, issues: DataFrame, sessions: DataFrame) -> DataFrame:
    """The catalogue's own state as (name, label, value): sources by status, bytes behind, unreadable records by kind, links that
    aren't resolved. sources: path, status, size, offset; issues: kind; sessions: parent_uid, parent_id."""
    rows = [
        sources.groupBy("status").agg(F.count("*").alias("v")).select(F.lit("sources").alias("name"), F.col("status").alias("label"), F.col("v").cast("double").alias("value")),
        sources.agg(F.coalesce(F.sum(F.greatest(F.col("size") - F.col("offset"), F.lit(0))), F.lit(0)).alias("v")).select(F.lit("lag_bytes").alias("name"), F.lit("").alias("label"), F.col("v").cast("double").alias("value")),
        issues.groupBy("kind").agg(F.count("*").alias("v")).select(F.lit("parse_issues").alias("name"), F.col("kind").alias("label"), F.col("v").cast("double").alias("value")),
        sessions.agg(F.count_if(F.col("parent_uid").isNotNull() & F.col("parent_id").isNull()).alias("v")).select(F.lit("unresolved_links").alias("name"), F.lit("").alias("label"), F.col("v").cast("double").alias("value")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def pruned(state: DataFrame, at: str, now, days: int = 2, open_flag: str | None = None) -> DataFrame:
    """State rows that are kept: touched within so many days, or still open."""
    fresh = F.unix_micros(F.col(at)) >= F.unix_micros(F.lit(now).cast("timestamp")) - days * DAY
    return state.filter(fresh if open_flag is None else fresh | F.coalesce(open_flag, F.lit(False)))


def reclassified(messages: DataFrame, classify) -> DataFrame:
    """(event_uid, message_class, new_class) of the messages whose class a changed rule (a function of columns) changes."""
    return messages.withColumn("new_class", classify).filter(~F.col("message_class").eqNullSafe(F.col("new_class"))).select("event_uid", "message_class", "new_class")


def synced(stored: DataFrame, given: DataFrame, key: Sequence[str], version: str, since=None, full: bool = False) -> DataFrame:
    """A mirror of an outside table after a pass: rows of a newer version take the place of stored ones; of given only those beyond
    a watermark count, unless it is a full pass, which also drops what is no longer there."""
    new = given if full or since is None else given.filter(F.col(version) > F.lit(since))
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in stored.columns if c not in key]
    merged = both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(version, "_new")).alias("r")).select(*key, "r.*").select(*stored.columns)
    return merged.join(given.select(*key).distinct(), list(key), "left_semi") if full else merged


def repositories(sessions: DataFrame, root: Column, name: Column) -> DataFrame:
    """(local_root, name, sessions, first_ts, last_ts) of every checkout that sessions (first_ts, last_ts) worked in."""
    found = sessions.select(root.alias("local_root"), name.alias("name"), "first_ts", "last_ts").filter("local_root IS NOT NULL")
    return found.groupBy("local_root", "name").agg(F.count("*").alias("sessions"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
