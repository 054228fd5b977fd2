"""Queries over documents, pages, conversations and embeddings, which stand for messages, paths, sessions and chunks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomlog.functions import classify, names, text
from loomlog.operators import search, vectors

from .catalogue import query

#: Three short queries for the search operators.
QUERIES = ((1, "the of and"), (2, "tion heed then"), (3, "und der ist"))
_Q = "(VALUES (1, 'the of and'), (2, 'tion heed then'), (3, 'und der ist')) v(qid, words)"


@query(
    "content_fingerprint",
    "SELECT conv_id, count(*) AS turns, md5(string_agg(turn || ':' || md5(text), ',' ORDER BY turn)) AS fingerprint FROM conversations GROUP BY 1",
)
def content_fingerprint(t):
    """A hash of a session's content in order; the texts are hashed before they are gathered."""
    rows = t("conversations").select("conv_id", "turn", F.md5("text").alias("h"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "h"))), lambda s: F.concat(s["turn"].cast("string"), F.lit(":"), s["h"])), ",")
    return rows.groupBy("conv_id").agg(F.count("*").alias("turns"), F.md5(joined).alias("fingerprint"))


@query("sequence_numbers", "SELECT conv_id, turn, 100 + row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, md5(text)) AS seq FROM conversations")
def sequence_numbers(t):
    """Deterministic numbers after a base."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", F.md5("text"))
    return t("conversations").select("conv_id", "turn", (F.lit(100) + F.row_number().over(w)).cast("long").alias("seq"))


@query(
    "first_genuine_prompt",
    "SELECT conv_id, arg_min(turn, turn) AS turn, md5(arg_min(text, turn)) AS prompt FROM conversations WHERE role = 'user' GROUP BY 1",
)
def first_genuine_prompt(t):
    """The first message of a session that is the owner's own words."""
    rows = t("conversations").withColumn("cls", F.when(F.col("role") == "user", "human_prompt").otherwise(F.col("role")))
    own = rows.filter(classify.genuine_prompt(F.col("cls"), F.lit(None).cast("string"), F.col("text")))
    return own.groupBy("conv_id").agg(F.min("turn").alias("turn"), F.md5(F.min_by("text", "turn")).alias("prompt"))


@query("turn_counts_by_role", "SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS users, count(*) FILTER (WHERE role = 'assistant') AS assistants, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1")
def turn_counts_by_role(t):
    by = lambda r: F.count_if(F.col("role") == r)
    return t("conversations").groupBy("conv_id").agg(by("user").alias("users"), by("assistant").alias("assistants"), F.sum(F.length("text")).alias("chars"))


@query(
    "model_timeline_unnest",
    "SELECT conv_id % 10 AS bucket, role, count(DISTINCT conv_id) AS sessions FROM (SELECT conv_id, unnest(list(DISTINCT role)) AS role FROM conversations GROUP BY conv_id) GROUP BY 1, 2",
)
def model_timeline_unnest(t):
    """Sessions by each of the values in an array column."""
    sets = t("conversations").groupBy("conv_id").agg(F.collect_set("role").alias("roles"))
    return sets.select("conv_id", F.explode("roles").alias("role")).groupBy((F.col("conv_id") % 10).alias("bucket"), "role").agg(F.countDistinct("conv_id").alias("sessions"))


def _failure_sql() -> str:
    arms = " ".join(f"WHEN regexp_matches(html, '(?is)({p})') THEN '{n}'" for n, p in classify.FAILURES)
    return f"SELECT page_id, CASE {arms} ELSE 'other' END AS failure FROM pages"


@query("error_classifier", _failure_sql())
def error_classifier(t):
    """The ordered failure classes over page bodies."""
    return t("pages").select("page_id", classify.text_failure_class(F.col("html")).alias("failure"))


@query(
    "exec_classifier",
    f"""SELECT page_id, CASE WHEN t = '' THEN 'noop' WHEN NOT contains(t, 'tools.') AND NOT contains(t, '$') AND length(t) < 80 THEN 'noop'
    WHEN regexp_matches(t, '(?s){classify.WAIT_COMMANDS}') THEN 'wait' WHEN regexp_matches(t, '{classify.STATUS_COMMANDS}') THEN 'status' ELSE 'work' END AS cls
    FROM (SELECT page_id, CASE page_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'ls ' || url WHEN 2 THEN 'tools.run sleep 5 ' || url WHEN 3 THEN 'tools.sh git status ' || url WHEN 4 THEN 'tools.sh make ' || url ELSE 'gh run watch ' || url || repeat('x', 80) END AS t FROM pages)""",
)
def exec_classifier(t):
    """Commands as noop, wait, status or work."""
    n, url = F.col("page_id") % 6, F.col("url")
    made = F.when(n == 0, "").when(n == 1, F.concat(F.lit("ls "), url)).when(n == 2, F.concat(F.lit("tools.run sleep 5 "), url)).when(n == 3, F.concat(F.lit("tools.sh git status "), url)).when(n == 4, F.concat(F.lit("tools.sh make "), url))
    command = made.otherwise(F.concat(F.lit("gh run watch "), url, F.lit("x" * 80)))
    return t("pages").select("page_id", classify.command_class(command).alias("cls"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@query(
    "task_mentions",
    rf"""WITH p AS (SELECT doc_id, regexp_extract_all(replace(translate(text, '{_UPPER.lower()}', '{_UPPER}'), ',', '-7,'), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+') AS w FROM documents),
    k AS (SELECT doc_id, w[i] AS a, w[i + 1] AS dash, w[i + 2] AS n FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM p))
    SELECT a || '-' || lpad(n, greatest(length(n), 4)::INTEGER, '0') AS key, count(DISTINCT doc_id) AS docs FROM k WHERE regexp_full_match(a, '[A-Z][A-Z]+') AND dash = '-' AND regexp_full_match(n, '[0-9]+') GROUP BY 1""",
)
def task_mentions(t):
    """Task keys found anywhere in the whole texts of all documents, normalised, with the number of documents each. The test texts
    hold none, so a word before a comma is made one in both engines."""
    made = F.replace(F.translate("text", _UPPER.lower(), _UPPER), F.lit(","), F.lit("-7,"))
    return t("documents").select("doc_id", F.explode(names.task_mentions(made, 4)).alias("key")).groupBy("key").agg(F.count("*").alias("docs"))


@query("task_mentions_whole_text")
def task_mentions_whole_text(t):
    """The task keys of every document, wherever in its text they stand, in all languages."""
    return t("documents").select("doc_id", names.task_mentions(F.col("text"), 4).alias("keys"))


@query(
    "slug_project_feature_keys",
    r"""SELECT page_id, nullif(lower(regexp_replace(regexp_replace(url, '(\.git)?/*$', ''), '^(?:[a-z+]+://)?(?:[^@/]+@)?([^:/]+)(?::[0-9]+)?[:/]+', '\1/')), '') AS slug,
    coalesce(nullif(regexp_replace(url, '^.*/', ''), ''), '(none)') AS project, regexp_replace(lower(ltrim(url, '/')), '[^a-z0-9-]+', '_', 'g') AS feature FROM pages""",
)
def slug_project_feature_keys(t):
    url = F.col("url")
    return t("pages").select("page_id", names.remote_slug(url).alias("slug"), names.project_of(url).alias("project"), names.feature_key(url).alias("feature"))


@query("token_estimate", r"SELECT doc_id, ceil(length(p) / 3 + (length(text) - length(p)) * 1.5)::BIGINT AS tokens FROM (SELECT doc_id, text, regexp_replace(text, '[^\x00-\x7F]', '', 'g') AS p FROM documents)")
def token_estimate(t):
    return t("documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@query("secret_redaction_flags")
def secret_redaction_flags(t):
    """Credentials by document."""
    return t("documents").select("doc_id", text.secret_count("text").alias("secrets"), F.sha2(text.redacted("text"), 256).alias("redacted"))


@query("chunk_spans")
def chunk_spans(t):
    """Chunks of every text."""
    return t("documents").select("doc_id", F.posexplode(text.chunk_spans("text")).alias("chunk", "span")).select("doc_id", "chunk", "span.begin", "span.end")


@query("excerpt_around")
def excerpt_around(t):
    return t("documents").select("doc_id", text.excerpt_around(F.col("text"), "the tion", 60).alias("excerpt"))


_TOKENS = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


def _bm25_sql(mode: str) -> str:
    return rf"""WITH d AS (SELECT doc_id, {_TOKENS} AS ts FROM documents), s AS (SELECT count(*)::DOUBLE AS n, avg(len(ts)) AS m FROM d WHERE len(ts) > 0),
    p AS (SELECT doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM d) GROUP BY 1, 2),
    q AS (SELECT qid AS query_id, unnest(string_split(words, ' ')) AS term, len(string_split(words, ' ')) AS w FROM {_Q}),
    f AS (SELECT term, count(*) AS df FROM p GROUP BY 1)
    SELECT query_id, doc_id, round(sum(ln(1 + (s.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * p.n / m))), 6) AS score
    FROM q JOIN p USING (term) JOIN f USING (term), s GROUP BY 1, 2 {"HAVING count(*) = max(w)" if mode == "all" else ""}"""


def _bm25(t, mode: str):
    docs = t("documents")
    queries = docs.sparkSession.createDataFrame(QUERIES, "query_id int, query string")
    return search.bm25(docs, "doc_id", "text", queries, mode=mode).withColumn("score", F.round("score", 6))


@query("bm25_any", _bm25_sql("any"))
def bm25_any(t):
    return _bm25(t, "any")


@query("bm25_all", _bm25_sql("all"))
def bm25_all(t):
    return _bm25(t, "all")


@query(
    "phrase_search",
    rf"""SELECT doc_id FROM (SELECT doc_id, ' ' || array_to_string({_TOKENS}, ' ') || ' ' AS x FROM documents) WHERE contains(x, ' of the ')""",
)
def phrase_search(t):
    return search.phrase(t("documents"), "doc_id", "text", "of the").select("doc_id")


_COS = "list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7))"


@query("vector_topk", f"SELECT vec_id, round(1 - {_COS}, 6) AS distance FROM embeddings ORDER BY 1 - {_COS}, vec_id LIMIT 10")
def vector_topk(t):
    """The ten nearest vectors to one of them (a report)."""
    e = t("embeddings")
    asked = vectors.vector_of(e.filter("vec_id = 7"), "embedding")
    return vectors.nearest(e, "vec_id", "embedding", asked, 10).withColumn("distance", F.round("distance", 6))


@query("similar_messages", f"SELECT vec_id, round(1 - {_COS}, 6) AS distance FROM embeddings WHERE 1 - {_COS} <= 0.9 ORDER BY 1 - {_COS}, vec_id LIMIT 20")
def similar_messages(t):
    """Vectors within a radius, at most twenty (a report)."""
    e = t("embeddings")
    asked = vectors.vector_of(e.filter("vec_id = 7"), "embedding")
    return vectors.nearest(e, "vec_id", "embedding", asked, 20, 0.9).withColumn("distance", F.round("distance", 6))


@query(
    "similar_sessions",
    """WITH m AS (SELECT label, list(x ORDER BY i) AS v FROM (SELECT label, i, avg(e) AS x FROM (SELECT label, unnest(embedding::DOUBLE[]) AS e, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1)
    SELECT a.label, b.label AS other, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM m a JOIN m b ON a.label < b.label""",
)
def similar_sessions(t):
    """Similarity of the mean vectors of each two labels."""
    pairs = vectors.similar_pairs(vectors.mean_vector(t("embeddings"), "label", "embedding"), "label", "embedding")
    return pairs.select("label", "other", F.round("similarity", 6).alias("similarity"))


@query(
    "similar_to_session",
    """WITH m AS (SELECT label, list(x ORDER BY i) AS v FROM (SELECT label, i, avg(e) AS x FROM (SELECT label, unnest(embedding::DOUBLE[]) AS e, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1)
    SELECT label, round(1 - list_cosine_similarity(v, (SELECT v FROM m WHERE label = 3)), 6) AS distance FROM m WHERE label <> 3 ORDER BY 2, 1 LIMIT 5""",
)
def similar_to_session(t):
    """The five labels whose mean vectors are nearest to one label's (a report)."""
    means = vectors.mean_vector(t("embeddings"), "label", "embedding")
    asked = vectors.vector_of(vectors.mean_vector(t("embeddings").filter("label = 3"), "label", "embedding"), "embedding")
    return vectors.nearest(means.filter("label <> 3"), "label", "embedding", asked, 5, digits=6)


@query(
    "hybrid_rrf",
    f"""WITH b AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank_a FROM ({_bm25_sql("any")}) WHERE query_id = 2 QUALIFY rank_a <= 50),
    v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY round(1 - {_COS}, 6), vec_id) AS rank_b FROM embeddings QUALIFY rank_b <= 50)
    SELECT id, rank_a, rank_b, round(coalesce(0.3 / (60 + rank_a), 0) + coalesce(0.7 / (60 + rank_b), 0), 8) AS score FROM b FULL JOIN v USING (id)""",
)
def hybrid_rrf(t):
    """The fifty best by words and the fifty best by vectors, fused by rank."""
    docs, e = t("documents"), t("embeddings")
    queries = docs.sparkSession.createDataFrame(QUERIES[1:2], "query_id int, query string")
    words = search.bm25(docs, "doc_id", "text", queries).select(F.col("doc_id").alias("id"), F.round("score", 6).alias("s")).orderBy(F.desc("s"), "id").limit(50)
    near = vectors.nearest(e, "vec_id", "embedding", vectors.vector_of(e.filter("vec_id = 7"), "embedding"), 50, digits=6).select(F.col("vec_id").alias("id"), F.col("distance").alias("d"))
    # fifty rows each: the rank needs no more than one task
    ranked = lambda df, name, *order: df.withColumn(name, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).cast("long"))
    return search.fused(ranked(words, "rank_a", F.desc("s"), F.col("id")), ranked(near, "rank_b", F.col("d"), F.col("id")), ["id"]).select("id", "rank_a", "rank_b", F.round("score", 8).alias("score"))
